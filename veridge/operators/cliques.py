"""Maximal cliques, maximum cliques and vertex covers: exact search per root vertex, on its later neighbours.

Vertices are ordered by coreness, so a root has at most as many later neighbours as the graph's degeneracy, and its task sees only the edges among them. Those come from one join of wedges with edges; no adjacency is collected on the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridge.graph import Graph
from veridge.operators.structure import components, coreness, degeneracy_order
from veridge.runtime import written


def _bits(n: int):
    while n:
        low = n & -n
        yield low.bit_length() - 1
        n ^= low


def _expand(adj: list[int], r: list[int], p: int, x: int, out) -> None:
    """Bron-Kerbosch with a pivot over bit sets; calls ``out`` with each maximal clique."""
    stack = [(r, p, x)]
    while stack:
        r, p, x = stack.pop()
        if not p:
            if not x:
                out(r)
            continue
        pivot = max(_bits(p | x), key=lambda u: (p & adj[u]).bit_count())
        for v in list(_bits(p & ~adj[pivot])):
            stack.append(([*r, v], p & adj[v], x & adj[v]))
            p &= ~(1 << v)
            x |= 1 << v


def _colour_bound(adj: list[int], p: int) -> list[tuple[int, int]]:
    """Vertices of ``p`` by greedy colour class, with the number of classes so far."""
    out, classes = [], 0
    while p:
        classes, q = classes + 1, p
        while q:
            v = (q & -q).bit_length() - 1
            q &= ~(adj[v] | 1 << v)
            p &= ~(1 << v)
            out.append((v, classes))
    return out


def largest_clique(adj: list[int], least: int = 0) -> list[int]:
    """A largest clique of more than ``least`` vertices, or an empty list; branch and bound by colours."""
    best: list[int] = []

    def grow(r: list[int], p: int) -> None:
        nonlocal best
        for v, bound in reversed(_colour_bound(adj, p)):
            if len(r) + bound <= max(len(best), least):
                return
            if p & adj[v]:
                grow([*r, v], p & adj[v])
            elif len(r) + 1 > max(len(best), least):
                best = [*r, v]
            p &= ~(1 << v)

    grow([], (1 << len(adj)) - 1)
    return best


def smallest_cover(edges: list[tuple[int, int]]) -> set[int]:
    """A smallest vertex cover of a small graph: what a largest clique of the complement leaves. Vertices of one neighbour go by that neighbour first."""
    nb: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            nb.setdefault(a, set()).add(b)
            nb.setdefault(b, set()).add(a)
    cover: set[int] = set()

    def take(v: int) -> None:
        cover.add(v)
        for u in nb.pop(v):
            nb[u].discard(v)

    while ones := [v for v in nb if len(nb[v]) == 1]:
        if ones[0] in nb and nb[ones[0]]:
            take(next(iter(nb[ones[0]])))
        for v in [v for v in nb if not nb[v]]:
            del nb[v]
    left = sorted(nb)
    place = {v: i for i, v in enumerate(left)}
    full = (1 << len(left)) - 1
    adj = [full & ~(1 << i) & ~sum(1 << place[u] for u in nb[v]) for i, v in enumerate(left)]
    apart = {left[i] for i in largest_clique(adj)} if left else set()
    return cover | (set(left) - apart)


def _neighbourhoods(graph: Graph, core: DataFrame | None = None, rank: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By rank: (root, v) later neighbours, (root, a, b) edges among them with a < b, and (rank, id).

    A triangle is found once, from two later edges of its first vertex, of which each has at most as many as the degeneracy; a hub's earlier neighbours make no wedge.
    """
    if rank is None:
        rank = written(degeneracy_order(graph, written(coreness(graph) if core is None else core)))
    e = graph.edges.where("src <> dst").select("src", "dst").distinct()
    later = written(e.join(rank.toDF("src", "root"), "src").join(rank.toDF("dst", "v"), "dst").where("root < v").select("root", "v"))
    wedge = later.select("root", F.col("v").alias("a")).join(later.select("root", F.col("v").alias("b")), "root").where("a < b")
    inner = wedge.join(later.toDF("a", "b"), ["a", "b"], "left_semi").select("root", "a", "b")
    return later, written(inner), rank


def _local(near: pd.DataFrame, inner: pd.DataFrame) -> tuple[list[int], dict[int, int], list[int]]:
    ids = sorted(near["v"].tolist(), key=int)
    place = {v: i for i, v in enumerate(ids)}
    adj = [0] * len(ids)
    for a, b in zip(inner["a"], inner["b"], strict=True):
        i, j = place[a], place[b]
        adj[i] |= 1 << j
        adj[j] |= 1 << i
    return ids, place, adj


def clique_histogram(graph: Graph, core: DataFrame | None = None) -> DataFrame:
    """``(size, n)``: how many maximal cliques of each size a symmetric graph has; isolated vertices don't count.

    A root's task has its later neighbours and, of its earlier ones, which keep cliques from being maximal, the distinct sets of later neighbours that they know.
    """
    near, inner, _ = _neighbourhoods(graph, core)
    blocks = inner.select(F.col("a").alias("root"), F.col("root").alias("x"), F.col("b").alias("v")).groupBy("root", "x").agg(F.sort_array(F.collect_set("v")).alias("known")).select("root", "known").distinct()
    none = F.lit(None)
    right = inner.select("root", "a", "b", none.cast("array<long>").alias("known")).union(blocks.select("root", none.cast("long"), none.cast("long"), "known"))

    def count(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["size", "n"])
        _, place, adj = _local(left, right[right["known"].isna()])
        p, x = (1 << len(adj)) - 1, 0
        for known in right["known"].dropna():
            x |= 1 << len(adj)
            mask = sum(1 << place[v] for v in known)
            for v in known:
                adj[place[v]] |= 1 << len(adj)
            adj.append(mask)
        found: dict[int, int] = {}
        _expand(adj, [], p, x, lambda r: found.__setitem__(len(r) + 1, found.get(len(r) + 1, 0) + 1))
        found.pop(1, None)
        return pd.DataFrame(sorted(found.items()), columns=["size", "n"])

    return near.groupBy("root").cogroup(right.groupBy("root")).applyInPandas(count, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))


def _named(spark, rank: DataFrame, ranks: list[int]) -> DataFrame:
    """``(size, members)`` of a clique of ranks; of none, the smallest vertex if there is one."""
    ids = [r["id"] for r in (rank.where(F.col("rank").isin(ranks)) if ranks else rank.orderBy("id").limit(1)).select("id").collect()]
    return spark.createDataFrame([(len(ids), sorted(int(i) for i in ids))] if ids else [], "size long, members array<long>")


def _best(near: DataFrame, inner: DataFrame, search) -> list[int]:
    found = near.groupBy("root").cogroup(inner.groupBy("root")).applyInPandas(search, "size long, members array<long>")
    got = found.orderBy(F.col("size").desc(), "members").limit(1).collect()
    return got[0]["members"] if got else []


def _greedy(adj: list[int]) -> list[int]:
    """A maximal clique: the last vertex that is left each time, by the order of ranks the one of highest core."""
    left, out = (1 << len(adj)) - 1, []
    while left:
        v = left.bit_length() - 1
        out.append(v)
        left &= adj[v]
    return out


def heuristic_clique(graph: Graph, core: DataFrame | None = None) -> DataFrame:
    """``(size, members)``: the largest clique that grows greedily from any vertex over its later neighbours, highest rank first; a lower bound of ``maximum_clique``."""
    near, inner, rank = _neighbourhoods(graph, core)

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["size", "members"])
        ids, _, adj = _local(left, right)
        found = _greedy(adj)
        return pd.DataFrame([(len(found) + 1, sorted([int(key[0]), *(int(ids[i]) for i in found)]))], columns=["size", "members"])

    return _named(graph.edges.sparkSession, rank, _best(near, inner, search))


def _searcher(least: int):
    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, _, adj = _local(left, right)
        found = largest_clique(adj, least) if len(ids) > least else []
        return pd.DataFrame([(len(found) + 1, [int(key[0]), *sorted(int(ids[i]) for i in found)])] if found else [], columns=["size", "members"])

    return search


def maximum_clique(graph: Graph, waves: int = 4, core: DataFrame | None = None) -> DataFrame:
    """``(size, members)``: a largest clique of a symmetric graph. Roots of high coreness search first; what they find bounds the later waves, whose roots must have the coreness and the later neighbours for more."""
    core = written(coreness(graph) if core is None else core)
    near, inner, rank = _neighbourhoods(graph, core)
    ranks = rank.join(core, "id")
    top = core.agg(F.max("coreness")).first()[0]
    best: list[int] = []
    high = (top or 0) + 1
    for i in range(waves if top is not None else 0):
        low = round(top * (waves - 1 - i) / waves)
        roots = ranks.where((F.col("coreness") >= max(low, len(best))) & (F.col("coreness") < high)).select(F.col("rank").alias("root"))
        high, least = low, max(len(best) - 1, 0)
        got = _best(near.join(roots, "root", "left_semi"), inner.join(roots, "root", "left_semi"), _searcher(least))
        best = max(best, got, key=len)
    return _named(graph.edges.sparkSession, rank, best)


def vertex_cover(graph: Graph) -> DataFrame:
    """``(id, comp)``: a smallest vertex cover of a symmetric graph, component by component, each in a task; the search is exponential in what is left of a component once vertices of one neighbour are settled, so components must be small or sparse."""
    comps = written(components(graph))
    rows = graph.edges.where("src < dst").join(comps.toDF("src", "comp"), "src").select("comp", "src", "dst")

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))
        cover = smallest_cover(edges)
        return pd.DataFrame({"id": sorted(cover), "comp": int(key[0])})

    return rows.groupBy("comp").applyInPandas(solve, "id long, comp long")


def edge_clique_partition(graph: Graph, least: int = 4) -> DataFrame:
    """``(src, dst, first_src, first_dst)``: edges of a symmetric graph, src < dst, dealt to cliques of ``least`` or more vertices that share no edge, each named by its smallest edge; edges of none have nulls.

    Each root grows a greedy clique over its later neighbours; of cliques that share an edge the one of more vertices, then of the smaller root, takes it, and a clique that lost one gives up its edges and grows again next round without them, until no round finds one.
    """
    rest = written(graph.edges.where("src < dst").select("src", "dst").distinct())
    dealt = graph.edges.sparkSession.createDataFrame([], "src long, dst long, first_src long, first_dst long")
    rank = written(degeneracy_order(graph))

    def grow(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            ids, _, adj = _local(left, right)
            found = [int(key[0]), *(int(ids[i]) for i in _greedy(adj))]
            if len(found) >= least:
                found.sort()
                rows = [(int(key[0]), len(found), a, b) for i, a in enumerate(found) for b in found[i + 1 :]]
        return pd.DataFrame(rows, columns=["root", "size", "a", "b"])

    while True:
        both = rest.union(rest.select("dst", "src"))
        near, inner, _ = _neighbourhoods(Graph.of_edges(both, symmetric=True), rank=rank)
        found = written(near.groupBy("root").cogroup(inner.groupBy("root")).applyInPandas(grow, "root long, size long, a long, b long"))
        claim = found.select("a", "b", F.struct((-F.col("size")).alias("s"), "root").alias("c")).groupBy("a", "b").agg(F.min("c").alias("c"))
        lost = found.join(claim, ["a", "b"]).where(F.col("c.root") != F.col("root")).select("root").distinct()
        won = found.join(lost, "root", "left_anti")
        name = lambda c, to: rank.select(F.col("rank").alias(c), F.col("id").alias(to))
        named = written(won.join(name("a", "x"), "a").join(name("b", "y"), "b").select("root", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")))
        first = named.groupBy("root").agg(F.min(F.struct("src", "dst")).alias("f")).select("root", F.col("f.src").alias("first_src"), F.col("f.dst").alias("first_dst"))
        got = written(named.join(first, "root").select("src", "dst", "first_src", "first_dst"))
        if not got.take(1):
            none = F.lit(None).cast("long")
            return dealt.union(rest.select("src", "dst", none, none))
        dealt = written(dealt.union(got))
        rest = written(rest.join(got, ["src", "dst"], "left_anti"))


def triangles(graph: Graph) -> DataFrame:
    """``n``: triangles of a symmetric graph, each once, from edges directed to the end of higher degree."""
    deg = graph.edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))
    e = graph.edges.where("src <> dst").join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst").where("ds < dd or (ds = dd and src < dst)").select("src", "dst")
    e = written(e)
    wedge = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst")
    return wedge.join(e.select("src", F.col("dst").alias("far")), ["src", "far"], "left_semi").agg(F.count("*").alias("n"))
