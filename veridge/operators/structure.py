"""Components, cores, independent sets, colourings, and queries that check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridge.functions.scalar import mex
from veridge.graph import Graph
from veridge.operators.components import connected_components
from veridge.runtime import drop_written, ranked, written


def components(graph: Graph) -> DataFrame:
    """``(id, comp)`` for all vertices of a symmetric graph; comp is the component's smallest id."""
    found = connected_components(graph.edges)
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def count_unique(labels: DataFrame, label: str) -> DataFrame:
    """``(n_labels, n, smallest, largest, most_label, least_label)``: sizes of the groups that a label makes; ties to the smaller label."""
    sizes = labels.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("k"))
    pick = lambda f, k: f(F.struct(k.alias("k"), (-F.col("l")).alias("l")))
    return sizes.agg(F.count("*").alias("n_labels"), F.sum("k").alias("n"), F.min("k").alias("smallest"), F.max("k").alias("largest"), pick(F.max, F.col("k")).alias("a"), pick(F.max, -F.col("k")).alias("b")).select("n_labels", "n", "smallest", "largest", (-F.col("a.l")).alias("most_label"), (-F.col("b.l")).alias("least_label"))


def coreness(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``(id, coreness)`` of a symmetric graph without self-edges, by lowering each vertex to the h-index of its neighbours until nothing falls.

    A round counts anew only vertices with a neighbour whose bound fell. A vertex' bound is counted over the (neighbour bound, count) pairs of its edges, summed map-side, so a hub's state is its number of distinct bounds.
    """
    deg = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("c"))
    state = written(graph.vertices.select("id").join(deg, "id", "left").select("id", F.coalesce("c", F.lit(0)).alias("c"), F.lit(True).alias("fell")))
    for k in range(max_rounds):
        if not state.where("fell").take(1):
            return state.select("id", F.col("c").alias("coreness"))
        edges = graph.edges
        if k:
            near = edges.join(state.where("fell").select(F.col("id").alias("dst")), "dst", "left_semi").select("src").distinct()
            edges = edges.join(near, "src", "left_semi")
        pairs = edges.join(state.select(F.col("id").alias("dst"), F.col("c").alias("nc")), "dst").groupBy("src", "nc").agg(F.count("*").alias("k"))
        above = F.sum("k").over(Window.partitionBy("src").orderBy(F.col("nc").desc()))
        h = pairs.withColumn("above", above).groupBy(F.col("src").alias("id")).agg(F.max(F.least("nc", "above")).alias("h"))
        new = F.least("c", F.coalesce("h", "c"))
        state = written(state.join(h, "id", "left").select("id", new.alias("c"), (new < F.col("c")).alias("fell")), instead_of=state)
    raise RuntimeError("no fixpoint")


#: Vertex orders: by coreness, degree or both, rising or falling; ids always rise.
ORDERS = {
    "core_degree": (("coreness", False), ("deg", False)),
    "core_degree_desc": (("coreness", True), ("deg", True)),
    "core_up_degree_down": (("coreness", False), ("deg", True)),
    "core_down_degree_up": (("coreness", True), ("deg", False)),
    "core": (("coreness", False),),
    "core_desc": (("coreness", True),),
    "degree": (("deg", False),),
    "degree_desc": (("deg", True),),
}


def degeneracy_order(graph: Graph, core: DataFrame | None = None, by: str = "core_degree") -> DataFrame:
    """``(id, rank)``: vertices in one of ``ORDERS``, ties by id."""
    keys = ORDERS[by]
    deg = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    rows = graph.vertices.select("id").join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    if any(k == "coreness" for k, _ in keys):
        rows = rows.join(coreness(graph) if core is None else core, "id")
    return ranked(rows, [*(F.col(k).desc() if down else F.col(k) for k, down in keys), F.col("id")], "rank").select("id", "rank")


def independent_set(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``id``: the lexicographically first maximal independent set of a symmetric graph.

    A vertex joins when no undecided neighbour is smaller; its neighbours go. Self-edges say nothing.
    """
    edges = written(graph.edges.where("src <> dst").select("src", "dst"))
    left = written(graph.vertices.select("id"))
    chosen = None
    for _ in range(max_rounds):
        least = edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
        now = written(left.join(least, "id", "left").where("m is null or m > id").select("id"))
        chosen = now if chosen is None else written(chosen.union(now), instead_of=chosen)
        gone = written(now.union(edges.join(now.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))).distinct())
        left = written(left.join(gone, "id", "left_anti"), instead_of=left)
        if not left.take(1):
            return chosen
        edges = written(edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"), instead_of=edges)
        drop_written(gone)
    raise RuntimeError("no fixpoint")


def _priority_edges(graph: Graph) -> DataFrame:
    """(id, parent): neighbours that come first, by larger degree, then smaller id."""
    deg = graph.edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))
    a, b = deg.toDF("src", "ds"), deg.toDF("dst", "dd")
    return graph.edges.where("src <> dst").join(a, "src").join(b, "dst").where("dd > ds or (dd = ds and dst < src)").select(F.col("src").alias("id"), F.col("dst").alias("parent"))


def colouring(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``(id, color)``: greedy colours of a symmetric graph in order of degree, largest first, then id, by Jones-Plassmann rounds.

    A vertex' state is the distinct colours of its parents. A round reads the edges of vertices without a colour only: those whose parents all have one take theirs and leave.
    """
    edges = written(_priority_edges(graph).withColumn("pc", F.lit(None).cast("long")))
    left, done = written(graph.vertices.select("id")), None
    for _ in range(max_rounds):
        seen = edges.groupBy("id").agg(F.collect_set("pc").alias("used"), F.bool_or(F.col("pc").isNull()).alias("waits"))
        now = written(left.join(seen, "id", "left").where(~F.coalesce("waits", F.lit(False))).select("id", F.coalesce(mex(F.col("used")).cast("long"), F.lit(0).cast("long")).alias("color")))
        done = now if done is None else written(done.union(now))
        left = written(left.join(now, "id", "left_anti"), instead_of=left)
        if not left.take(1):
            return done
        new = now.select(F.col("id").alias("parent"), "color")
        kept = edges.join(now.select("id"), "id", "left_anti").join(new, "parent", "left").select("id", "parent", F.coalesce("pc", "color").alias("pc"))
        edges = written(kept, instead_of=edges)
    raise RuntimeError("no fixpoint")


def dag_depth(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """``(id, depth)`` in the graph of colouring priorities: 0 for vertices without parents, else one more than the deepest parent."""
    parents = written(_priority_edges(graph))
    state = written(graph.vertices.select("id", F.lit(0).cast("long").alias("depth"), F.lit(True).alias("rose")))
    for _ in range(max_rounds):
        if not state.where("rose").take(1):
            return state.select("id", "depth")
        got = parents.join(state.where("rose").select(F.col("id").alias("parent"), "depth"), "parent").groupBy("id").agg((F.max("depth") + 1).alias("got"))
        new = F.greatest("depth", F.coalesce("got", F.lit(0)))
        state = written(state.join(got, "id", "left").select("id", new.alias("depth"), (new > F.col("depth")).alias("rose")), instead_of=state)
    raise RuntimeError("no fixpoint: the graph changed")


def speculative_colouring(graph: Graph, rounds: int = 2) -> DataFrame:
    """``(id, color)``: proper colours, guessed for all at once and mended where the smaller end of an edge clashes; what still clashes is coloured in priority order."""
    edges = written(graph.edges.where("src <> dst").select("src", "dst"))
    state = written(graph.vertices.select("id", F.lit(0).cast("long").alias("color")))
    for k in range(rounds):
        clash = edges.join(state.toDF("src", "a"), "src").join(state.toDF("dst", "b"), "dst").where("a = b and src < dst").select(F.col("dst").alias("id")).distinct()
        used = edges.join(clash.withColumnRenamed("id", "src"), "src", "left_semi").join(state.toDF("dst", "b"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("b").alias("used"))
        spread = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3))
        free = F.array_except(F.sequence(F.lit(0), F.size("used") + 2), F.transform("used", lambda x: x.cast("int")))
        state = written(state.join(used, "id", "left").select("id", F.when(F.col("used").isNull(), F.col("color")).otherwise(F.get(free, spread.cast("int")).cast("long")).alias("color")))
    clash = written(edges.join(state.toDF("src", "a"), "src").join(state.toDF("dst", "b"), "dst").where("a = b and src < dst").select(F.col("dst").alias("id")).distinct())
    rest = colouring(Graph(clash, edges.join(clash.toDF("src"), "src", "left_semi").join(clash.toDF("dst"), "dst", "left_semi"), True))
    top = state.agg(F.max("color")).first()[0] or 0
    return state.join(rest.select("id", (F.col("color") + top + 1).alias("again")), "id", "left").select("id", F.coalesce("again", "color").alias("color"))


def degree_two_chains(graph: Graph) -> DataFrame:
    """``(id, chain)``: vertices of degree two by the path or cycle of such vertices that they lie on, named by its smallest id."""
    two = graph.degrees().where("out_deg = 2").select("id")
    return components(graph.induced(two)).withColumnRenamed("comp", "chain")


def stars(graph: Graph) -> DataFrame:
    """``(centre, leaf)``: vertices of degree one by their only neighbour, for contraction; of two that have only each other the smaller is the centre."""
    deg = graph.degrees()
    one = deg.where("out_deg = 1").select(F.col("id").alias("leaf"))
    rows = graph.edges.where("src <> dst").join(one, F.col("src") == F.col("leaf"), "left_semi").select(F.col("dst").alias("centre"), F.col("src").alias("leaf"))
    pairs = rows.select(F.col("leaf").alias("centre"), F.col("centre").alias("leaf"))
    return rows.where("centre < leaf").union(rows.where("centre > leaf").join(pairs, ["centre", "leaf"], "left_anti"))


def edge_cover(graph: Graph) -> DataFrame:
    """``(src, dst)``: edges that touch every vertex that has one: each vertex' edge to its smallest neighbour, once."""
    least = graph.edges.where("src <> dst").groupBy("src").agg(F.min("dst").alias("dst"))
    return least.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


# -- checks: each gives counts of violations ---------------------------------------------------------------------------------------


def check_components(graph: Graph, comp: DataFrame) -> DataFrame:
    a, b = comp.toDF("src", "a"), comp.toDF("dst", "b")
    cross = graph.edges.join(a, "src").join(b, "dst").agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_crossing"))
    return cross.crossJoin(comp.agg(F.count("*").alias("n"))).select("n", "n_crossing")


def check_coreness(graph: Graph, core: DataFrame) -> DataFrame:
    a, b = core.toDF("src", "a"), core.toDF("dst", "b")
    per = graph.edges.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"), F.count(F.when(F.col("b") >= F.col("a"), 1)).alias("ge"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("gt"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return core.join(per, "id", "left").agg(F.count("*").alias("n"), F.count(F.when(F.col("coreness") > z("deg"), 1)).alias("n_over_degree"), F.count(F.when((F.col("coreness") == 0) & (z("deg") > 0), 1)).alias("n_zero"), F.count(F.when(z("ge") < F.col("coreness"), 1)).alias("n_too_few"), F.count(F.when(z("gt") > F.col("coreness"), 1)).alias("n_too_many"))


def check_independent_set(graph: Graph, chosen: DataFrame) -> DataFrame:
    inside = graph.edges.where("src <> dst").join(chosen.toDF("src"), "src", "left_semi")
    both = inside.join(chosen.toDF("dst"), "dst", "left_semi").agg(F.count("*").alias("n_adjacent"))
    open_ = graph.vertices.select("id").join(chosen, "id", "left_anti").join(inside.select(F.col("dst").alias("id")), "id", "left_anti").agg(F.count("*").alias("n_addable"))
    return chosen.agg(F.count("*").alias("n")).crossJoin(both).crossJoin(open_)


def check_colouring(graph: Graph, colours: DataFrame) -> DataFrame:
    a, b = colours.toDF("src", "a"), colours.toDF("dst", "b")
    bad = graph.edges.where("src <> dst").join(a, "src").join(b, "dst").agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("n_clashing"))
    return colours.agg(F.count("*").alias("n"), F.count(F.when(F.col("color").isNull(), 1)).alias("n_uncoloured")).crossJoin(bad)


def check_bfs(graph: Graph, tree: DataFrame) -> DataFrame:
    """``(n, n_skipping, n_bad_parent)``. Only edges of reached vertices are joined, and counted by destination and level before they meet the destination's level."""
    tree = written(tree)
    reached = written(tree.where("level is not null").select(F.col("id").alias("src"), F.col("level").alias("a")))
    out = graph.edges.join(reached, "src").groupBy(F.col("dst").alias("id"), "a").agg(F.count("*").alias("k"))
    skips = F.when(F.col("level").isNull() | (F.col("level") > F.col("a") + 1), F.col("k"))
    e = out.join(tree.select("id", "level"), "id").agg(F.coalesce(F.sum(skips), F.lit(0)).alias("n_skipping"))
    up = tree.where("level > 0").join(tree.select(F.col("id").alias("parent"), F.col("level").alias("pl")), "parent", "left").agg(F.count(F.when(F.col("pl").isNull() | (F.col("pl") != F.col("level") - 1), 1)).alias("n_bad_parent"))
    return tree.agg(F.count("*").alias("n")).crossJoin(e).crossJoin(up)
