import numpy as np
import pytest
from pyspark.sql import functions as F

from veridge import runtime
from veridge.graph import Graph
from veridge.operators import cliques, edgemap as em, reducers as red, structure as sg, traversal as tr
from veridge.plans import registry
from veridge.runtime import written
from veridge.sources import formats

PATH5 = [(0, 1), (1, 2), (2, 3), (3, 4)]
CYCLE5 = [*PATH5, (4, 0)]
K4TAIL = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5)]


def make(spark, edges, n, symmetric=True):
    rows = [*edges, *((b, a) for a, b in edges)] if symmetric else edges
    return Graph(spark.range(n).toDF("id"), spark.createDataFrame(rows, "src long, dst long"), symmetric)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(
    ("edges", "n", "core", "mis", "colours", "hist"),
    [
        (PATH5, 5, [1] * 5, [0, 2, 4], [1, 0, 1, 0, 1], {2: 4}),
        (CYCLE5, 5, [2] * 5, [0, 2], [0, 1, 0, 1, 2], {2: 5}),
        (K4TAIL, 7, [3, 3, 3, 3, 1, 1, 0], [0, 4, 6], [1, 2, 3, 0, 1, 0, 0], {2: 2, 4: 1}),
    ],
)
def test_structure(spark, edges, n, core, mis, colours, hist):
    g = make(spark, edges, n)
    c = sg.coreness(g)
    assert column(c, "coreness") == core
    assert sorted(r["id"] for r in sg.independent_set(g).collect()) == mis
    assert column(sg.colouring(g), "color") == colours
    assert {r["size"]: r["n"] for r in cliques.clique_histogram(g, c).collect()} == hist
    assert cliques.maximum_clique(g, core=c).first()["size"] == max(hist)


def test_traversal(spark):
    g = make(spark, K4TAIL, 7)
    assert column(tr.bfs(g), "level") == [0, 1, 1, 1, 2, 3, None]
    assert column(sg.components(g), "comp") == [0] * 6 + [6]
    assert column(tr.bfs(make(spark, PATH5, 5)), "parent") == [0, 0, 1, 2, 3]
    d = Graph(spark.range(4).toDF("id"), spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long"))
    assert column(tr.pagerank(d, 1, -1), "pr") == pytest.approx([0.14375, 0.25, 0.4625, 0.14375])
    assert column(tr.pagerank(d, 2, -1), "pr") == pytest.approx([0.166328125, 0.227421875, 0.439921875, 0.166328125])
    w = Graph(spark.range(4).toDF("id"), spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 1.0), (2, 3, 5.0)], "src long, dst long, weight double"))
    for delta in (None, 2.0):
        assert column(tr.sssp(w, 0, delta), "dist") == [0.0, 3.0, 1.0, 4.0]


def test_transforms_and_empty(spark):
    g = Graph(spark.range(3).toDF("id"), spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 0), (2, 1)], "src long, dst long"))
    assert g.without_duplicates().edges.count() == 4
    assert g.missing_reverses().first()[0] == 1
    assert {tuple(r) for r in g.without_self_edges().symmetrise().edges.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert tuple(g.check().first()) == (3, 5, 1, 1, 0, 0)
    empty = Graph(spark.range(2).toDF("id"), spark.createDataFrame([], "src long, dst long"), True)
    assert column(sg.components(empty), "comp") == [0, 1]
    assert column(sg.coreness(empty), "coreness") == [0, 0]
    assert column(tr.pagerank(empty), "pr") == pytest.approx([0.5, 0.5])
    assert em.edgemap(em.vertex_map(empty, value=F.lit(1)), lambda s, d, e: s("value"), red.SUM).where("touched").count() == 0


def test_components_of_long_paths(spark):
    n = 300
    g = make(spark, [(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)], n)
    assert set(column(sg.components(g), "comp")) == {0}


def test_files(spark, tmp_path):
    starts, targets = [0, 2, 3, 3], [1, 2, 2]
    edges = {(0, 1), (0, 2), (1, 2)}
    head = np.array([2, 1, 4, 3, 4, 8, 0, 0], "<u8").tobytes()
    (tmp_path / "g.bin").write_bytes(head + np.array(starts, "<u8").tobytes() + np.array(targets, "<u4").tobytes())
    (tmp_path / "g.adj").write_text("\n".join(["AdjacencyGraph", "4", "3", *map(str, starts), *map(str, targets)]))
    (tmp_path / "g.txt").write_text("# a comment\n0 1\n0 2\n1 2\n")
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 3\n2 1\n3 1\n3 2\n")
    for name in ("g.bin", "g.adj", "g.txt"):
        assert {(r["src"], r["dst"]) for r in formats.load_graph(spark, f"file://{tmp_path}/{name}").edges.collect()} == edges, name
    got = formats.load_graph(spark, f"file://{tmp_path}/g.mtx")
    assert {(r["src"], r["dst"]) for r in got.edges.collect()} == edges | {(b, a) for a, b in edges}


def brute_cliques(n, edges):
    """Sizes of maximal cliques, by growing all cliques."""
    nb = {v: set() for v in range(n)}
    for a, b in edges:
        nb[a].add(b)
        nb[b].add(a)
    level, hist = {frozenset((a, b)) for a, b in edges}, {}
    while level:
        bigger = set()
        for c in level:
            more = set.intersection(*(nb[v] for v in c))
            bigger |= {c | {v} for v in more}
            if not more:
                hist[len(c)] = hist.get(len(c), 0) + 1
        level = bigger
    return hist


def random_edges(n, p, seed):
    rng = np.random.default_rng(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


def test_cliques(spark):
    """Random graphs against brute force, beside a star that many leaves share."""
    for n, p, seed in ((24, 0.5, 1), (30, 0.25, 2)):
        edges = [*random_edges(n, p, seed), *((0, v) for v in range(n, n + 300))]
        g, hist = make(spark, edges, n + 300), brute_cliques(n + 300, edges)
        assert {r["size"]: r["n"] for r in cliques.clique_histogram(g).collect()} == hist
        best = cliques.maximum_clique(g).first()
        rows, have = cliques.heuristic_clique(g).first(), set(edges)
        assert best["size"] == max(hist) and rows["size"] <= best["size"]
        for found in (best, rows):
            m = found["members"]
            assert len(m) == found["size"] and all((a, b) in have for i, a in enumerate(m) for b in m[i + 1 :])


def test_star_of_many_leaves(spark):
    """A hub makes no wedges: its task sees nothing of its leaves."""
    g = Graph(spark.range(10_001).toDF("id"), spark.range(1, 10_001).selectExpr("0L as src", "id as dst").union(spark.range(1, 10_001).selectExpr("id", "0L")), True)
    assert {r["size"]: r["n"] for r in cliques.clique_histogram(g).collect()} == {2: 10_000}
    assert cliques._neighbourhoods(g)[1].count() == 0


def test_partition_and_cover(spark):
    edges = random_edges(16, 0.4, 5)
    g = make(spark, edges, 16)
    rows = cliques.edge_clique_partition(g).collect()
    assert sorted((r["src"], r["dst"]) for r in rows) == sorted(edges)
    by = {}
    for r in rows:
        if r["first_src"] is not None:
            by.setdefault((r["first_src"], r["first_dst"]), set()).update((r["src"], r["dst"]))
    sizes = {k: sum((r["first_src"], r["first_dst"]) == k for r in rows) for k in by}
    assert all(len(v) >= 4 and 2 * sizes[k] == len(v) * (len(v) - 1) for k, v in by.items())
    cover = {r["id"] for r in cliques.vertex_cover(g).collect()}
    least = min(bin(m).count("1") for m in range(1 << 16) if all(m >> a & 1 or m >> b & 1 for a, b in edges))
    assert len(cover) == least and all(a in cover or b in cover for a, b in edges)


def test_betweenness_beliefs_radius(spark):
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]
    g = make(spark, edges, 6)
    got = {r["id"]: (r["paths"], r["dependency"]) for r in tr.betweenness(g, 0).collect()}
    assert got == {0: (1.0, 4.0), 1: (1.0, 1.0), 2: (1.0, 1.0), 3: (2.0, 1.0), 4: (2.0, 0.0), 5: (None, None)}
    one = {r["id"]: r["b0"] for r in tr.belief_propagation(make(spark, [(0, 1)], 2), spark.createDataFrame([(0, 0.9, 0.1), (1, 0.5, 0.5)], "id long, p0 double, p1 double"), rounds=1).collect()}
    assert one[1] == pytest.approx(0.9 * 0.9 + 0.1 * 0.1) and one[0] == pytest.approx(0.9)
    rounds = [tuple(r) for r in tr.radius(make(spark, PATH5, 5)).collect()]
    assert len(rounds) <= 6 and rounds[-1][1] == 0 and all(b[2] >= a[2] for a, b in zip(rounds, rounds[1:], strict=False))


def test_written_formats(spark, tmp_path):
    """Every file format gives the graph back, weights and isolated vertices too."""
    edges = spark.createDataFrame([(0, 1, 1.5), (0, 3, 2.0), (3, 0, 0.25), (4, 4, 8.0)], "src long, dst long, weight double")
    g = Graph(spark.range(6).toDF("id"), edges)
    want = {tuple(r) for r in edges.collect()}
    path = lambda n: f"file://{tmp_path}/{n}"
    for version in (2, 3):
        formats.write_binary(g, path(f"b{version}"), version, path(f"w{version}"))
        back = formats.read_binary(spark, path(f"b{version}"), weights=path(f"w{version}"))
        assert {tuple(r) for r in back.edges.select("src", "dst", "weight").collect()} == want and back.vertices.count() == 6
    formats.write_config(g, path("c"))
    formats.write_adjacency(g, path("a"))
    formats.write_matrix_market(g, path("m"))
    for name in "cam":
        assert {tuple(r) for r in formats.load_graph(spark, path(name)).edges.select("src", "dst", "weight").collect()} == want, name
    formats.write_grazelle(g, path("z"), pull=True)
    assert {tuple(r) for r in formats.read_grazelle(spark, path("z"), pull=True).edges.collect()} == {r[:2] for r in want}
    ends, targets = np.array([2, 2, 2, 3, 4, 4], "<u8"), np.array([1, 3, 0, 4], "<u4")
    (tmp_path / "gr").write_bytes(np.array([1, 4, 6, 4], "<u8").tobytes() + ends.tobytes() + targets.tobytes() + np.array([1.5, 2.0, 0.25, 8.0], "<f4").tobytes())
    assert {tuple(r) for r in formats.load_graph(spark, path("gr")).edges.select("src", "dst", "weight").collect()} == want
    empty = Graph(spark.range(0).toDF("id"), spark.createDataFrame([], "src long, dst long"))
    formats.write_binary(empty, path("e"))
    assert formats.load_graph(spark, path("e")).edges.count() == 0
    formats.write_property(spark.createDataFrame([(2, 0.5), (0, 1.5), (1, -1.0)], "id long, value double"), path("p"))
    assert [r["value"] for r in formats.read_property(spark, path("p")).orderBy("id").collect()] == [1.5, -1.0, 0.5]
    (tmp_path / "f").write_text("1:2,3\n2:private\n4:notfound\n3:1\n")
    assert {tuple(r) for r in formats.read_friendster(spark, path("f")).edges.collect()} == {(1, 2), (1, 3), (3, 1)}


def plain_pagerank(edges, n, rounds, d=0.85):
    deg, pr = np.bincount([a for a, _ in edges], minlength=n), np.full(n, 1 / n)
    for _ in range(rounds):
        y = np.zeros(n)
        for a, b in edges:
            y[b] += d * pr[a] / deg[a]
        pr = y + (1 - y.sum()) / n
    return pr


def test_pagerank_reads_edges_of_roots_once(spark, monkeypatch):
    """Vertices without in-edges share a rank, so their edges aren't joined every round; others' are."""
    plans = []
    monkeypatch.setattr(tr, "written", lambda df, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, **k))
    roots = [(0, 3), (0, 4), (1, 4), (2, 3), (2, 4), (2, 5)]
    for edges, joins in ((roots, False), ([*roots, (4, 3), (3, 3), (5, 0)], True), ([(0, 1), (1, 2), (2, 0), (2, 1)], True)):
        g = make(spark, edges, 7, symmetric=False)
        few, many = [], []
        for rounds, into in ((2, few), (5, many)):
            plans.clear()
            assert column(tr.pagerank(g, rounds, -1), "pr") == pytest.approx(plain_pagerank(edges, 7, rounds), abs=1e-15)
            into.extend("Join" in p for p in plans)
        assert sum(many) - sum(few) == (3 if joins else 0)
    assert column(tr.pagerank(make(spark, roots, 7, symmetric=False), 5, -1, start=spark.createDataFrame([(0, 1.0)], "id long, pr double")), "pr")[6] > 0


def test_symmetrise_is_dealt_by_rows(spark, monkeypatch):
    """Tasks of a dealt shuffle grow in number, not in size; nothing is gathered in a task before it, and the directions are made after it."""
    monkeypatch.setattr(runtime, "TASK_ROWS", 10)
    rows = [(a % 17, a * 7 % 23) for a in range(400)] + [(None, 5), (5, None), (None, None), (3, 3)]
    e = spark.createDataFrame(rows, "src long, dst long")
    out = Graph(spark.range(23).toDF("id"), e, rows=404).symmetrise()
    got = [tuple(r) for r in out.edges.collect()]
    assert len(got) == len(set(got)) and set(got) == {*rows, *((b, a) for a, b in rows)}
    plan = out.edges._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    above, *below = plan.split("Exchange hashpartitioning")
    assert "Aggregate" in above and len(below) == 1 and "41), REPARTITION_BY_NUM" in below[0] and "Aggregate" not in below[0] and "Union" not in plan
    w = Graph(out.vertices, spark.createDataFrame([(0, 1, 4.0), (1, 0, 3.0), (2, 2, 1.0)], "src long, dst long, weight double")).symmetrise()
    assert {tuple(r) for r in w.edges.collect()} == {(0, 1, 3.0), (1, 0, 3.0), (2, 2, 1.0)}


def test_copurchases_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Pairs go to tasks of about TASK_ROWS before they are grouped, each once; directions are made after that."""
    rows = [(i % 40, (i * i + i // 7) % 29) for i in range(300)] + [(3, None), (None, 3), (None, 4), (5, 5), (5, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    met = {}
    for o, p in {r for r in rows if None not in r}:
        for q in {q for x, q in rows if x == o and q is not None and q != p}:
            met[p, q] = met.get((p, q), 0) + 1
    for task_rows in (1 << 19, 20):
        monkeypatch.setattr(runtime, "TASK_ROWS", task_rows)
        for name, least in (("copurchase", 1), ("copurchase2", 2)):
            g = registry.graph(spark, f"file://{tmp_path}", name, saved=False)
            got = [tuple(r) for r in g.edges.collect()]
            want = {k for k, n in met.items() if n >= least}
            assert len(got) == len(set(got)) and set(got) == want
            assert sorted(r["id"] for r in g.vertices.collect()) == sorted({a for a, _ in want})
            if task_rows == 20:
                by_pair = g.edges._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].split("Exchange hashpartitioning(src")
                assert "REPARTITION_BY_NUM" in by_pair[1] and "Aggregate" in by_pair[0] and "Aggregate" not in by_pair[1].split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]


def test_bfs_check_counts(spark):
    """Counts of violations in wrong trees, and one join of edges."""
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (5, 6)]
    g = make(spark, edges, 7)
    level, parent = [0, 1, 3, 3, None, None, 1], [0, 0, 1, 2, None, None, 3]
    tree = spark.createDataFrame([(i, level[i], parent[i]) for i in range(7)], "id long, level long, parent long")
    both = [*edges, *((b, a) for a, b in edges)]
    skips = sum(level[a] is not None and (level[b] is None or level[b] > level[a] + 1) for a, b in both)
    bad = sum((level[i] or 0) > 0 and (level[parent[i]] is None or level[parent[i]] != level[i] - 1) for i in range(7))
    found = sg.check_bfs(g, tree)
    assert tuple(found.first()) == (7, skips, bad) and skips and bad
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "Aggregate [dst" in plan
    assert tuple(sg.check_bfs(g, tr.bfs(g)).first()) == (7, 0, 0)
