"""Traversal and ranking: breadth-first search, shortest paths, PageRank and its kin, betweenness, beliefs, radii.

Every loop writes its state once a round and asks for convergence in one small aggregate of what it wrote. State is one row a vertex; edges are copied by PageRank only, without those that it needs once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridge.graph import Graph
from veridge.runtime import drop_written, written

DAMPING = 0.85


def bfs(graph: Graph, start: int = 0, max_rounds: int = 1 << 20) -> DataFrame:
    """``(id, level, parent)``; unreached vertices have nulls, and of possible parents the smallest counts."""
    start_row = graph.vertices.where(F.col("id") == start).select("id", F.lit(0).cast("long").alias("level"), F.col("id").alias("parent"))
    seen = front = written(start_row)
    for level in range(1, max_rounds):
        step = graph.edges.join(front.select(F.col("id").alias("src")), "src").groupBy("dst").agg(F.min("src").alias("parent"))
        front = written(step.withColumnRenamed("dst", "id").join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).cast("long").alias("level"), "parent"))
        if not front.take(1):
            break
        seen = seen.union(front) if level % 8 else written(seen.union(front))
    return graph.vertices.select("id").join(seen, "id", "left")


def sssp(graph: Graph, start: int = 0, delta: float | None = None) -> DataFrame:
    """``(id, dist)`` by weight; null where unreached. Weights mustn't be negative with ``delta``.

    Each round relaxes the edges of vertices whose distance fell. With ``delta`` only those in the lowest bucket of that width take part, others wait.
    """
    state = written(graph.vertices.select("id", F.when(F.col("id") == start, 0.0).alias("dist"), (F.col("id") == start).alias("todo")))
    n = graph.vertices.count()
    for _ in range(64 * n + 64):
        low = state.where("todo").agg(F.min("dist")).first()[0]
        if low is None:
            return state.select("id", "dist")
        limit = F.lit(True) if delta is None else F.floor(F.col("dist") / delta) <= int(low // delta)
        active = state.where(F.col("todo") & limit).select(F.col("id").alias("src"), "dist")
        got = graph.edges.join(active, "src").groupBy("dst").agg(F.min(F.col("dist") + F.col("weight")).alias("got")).withColumnRenamed("dst", "id")
        better = F.col("got").isNotNull() & (F.col("dist").isNull() | (F.col("got") < F.col("dist")))
        waits = F.lit(False) if delta is None else F.col("todo") & ~limit
        state = written(state.join(got, "id", "left").select("id", F.when(better, F.col("got")).otherwise(F.col("dist")).alias("dist"), (better | waits).alias("todo")), instead_of=state)
    raise RuntimeError("distances keep falling: a negative cycle")


def edge_profile(edges: DataFrame) -> DataFrame:
    """``(least, most, any_negative, any_zero)`` of weights; least is of what isn't zero."""
    a = F.abs("weight")
    return edges.agg(F.min(F.when(a != 0, a)).alias("least"), F.max(a).alias("most"), F.coalesce(F.bool_or(F.col("weight") < 0), F.lit(False)).alias("any_negative"), F.coalesce(F.bool_or(F.col("weight") == 0), F.lit(False)).alias("any_zero"))


def _with_degree(graph: Graph) -> DataFrame:
    deg = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    return graph.vertices.select("id").join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))


def _roots_apart(edges: DataFrame, base: DataFrame, damping: float) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """The edges of vertices that have in-edges, None if there are none; ``base`` (id, deg) with ``w``; and the table that it reads.

    Vertices without in-edges have one rank between them in every round, the even share. ``w`` times it is what they send to a vertex.
    """
    fed = written(edges.select(F.col("dst").alias("id")).distinct())
    base = written(base.join(fed.withColumn("fed", F.lit(True)), "id", "left").select("id", "deg", F.coalesce("fed", F.lit(False)).alias("fed")))
    sends = base.where("deg > 0")
    roots = sends.where("not fed").select(F.col("id").alias("src"), (damping / F.col("deg")).alias("c"))
    drop_written(fed)
    if not roots.take(1):
        return edges, base.select("id", "deg", F.lit(0.0).alias("w")), base
    w = edges.join(roots, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("c").alias("w"))
    inner = sends.where("fed").select(F.col("id").alias("src"))
    rest = written(edges.join(inner, "src", "left_semi").select("src", "dst")) if inner.take(1) else None
    return rest, base.join(w, "id", "left").select("id", "deg", F.coalesce("w", F.lit(0.0)).alias("w")), base


def pagerank(graph: Graph, rounds: int = 100, tolerance: float = 1e-7, damping: float = DAMPING, quantise: Callable[[Column], Column] | list | None = None, start: DataFrame | None = None) -> DataFrame:
    """``(id, pr)``: ranks that sum to one. What sinks and teleporting take is shared evenly each round.

    Stops after ``rounds``, or when the sum of changes is at most ``tolerance``; a negative tolerance gives exactly ``rounds``. ``quantise`` is put on contributions, for reduced precision; several precisions in stages are a list of (first round, function), the first from round 0. ``start`` (id, pr) replaces the even start.

    Without either, edges of vertices without in-edges are read once, before the first round.
    """
    base = _with_degree(graph)
    n = graph.vertices.count()
    if not n:
        return base.select("id", F.lit(None).cast("double").alias("pr"))
    edges, base, same = _roots_apart(graph.edges, base, damping) if start is None and quantise is None else (graph.edges, base.withColumn("w", F.lit(0.0)), None)
    first = base.withColumn("pr", F.lit(1.0 / n)) if start is None else base.join(start, "id", "left").fillna(0.0, ["pr"])
    state = held = written(first, instead_of=same)
    even = 1.0 / n
    stages = quantise if isinstance(quantise, (list, tuple)) else [(0, quantise or (lambda c: c))]
    for k in range(rounds):
        q = [f for since, f in stages if since <= k][-1]
        got = state.withColumn("y", F.lit(0.0))
        if edges is not None:
            out = state.where("deg > 0").select(F.col("id").alias("src"), q(damping * F.col("pr") / F.col("deg")).alias("c"))
            got = state.join(edges.join(out, "src").groupBy("dst").agg(F.sum("c").alias("y")).withColumnRenamed("dst", "id"), "id", "left")
        raw = held = written(got.select("id", "deg", "w", F.col("pr").alias("old"), (F.coalesce("y", F.lit(0.0)) + F.col("w") * even).alias("y")), instead_of=held)
        total = raw.agg(F.sum("y")).first()[0]
        even = (1 - total) / n
        state = raw.select("id", "deg", "w", (F.col("y") + even).alias("pr"), "old")
        # with an even share of what is missing the sum is one again, but for rounding
        if tolerance >= 0 and state.agg(F.sum(F.abs(F.col("pr") - F.col("old")))).first()[0] <= tolerance:
            break
        state = state.select("id", "deg", "w", "pr")
    return state.select("id", "pr")


def accelerated_pagerank(graph: Graph, rounds: int = 100, tolerance: float = 1e-7, damping: float = DAMPING, quantise: Callable[[Column], Column] | list | None = None) -> DataFrame:
    """``(id, x)``: PageRank by passing on changes; vertices whose change is over a hundredth of their rank are active. Ranks are scaled to a sum of one at the end.

    When more than 0.6 of vertices and their edges against all edges are active, all vertices pass on.
    """
    n, m = graph.vertices.count(), graph.edges.count()
    state = _with_degree(graph).withColumns({"x": F.lit(0.0), "delta": F.lit(1.0 / max(n, 1)), "act": F.lit(True)})
    state = written(state)
    stages = quantise if isinstance(quantise, (list, tuple)) else [(0, quantise or (lambda c: c))]
    for k in range(rounds):
        q = [f for since, f in stages if since <= k][-1]
        s = state.agg(F.sum(F.when(F.col("act"), 1 + F.col("deg")).otherwise(0)), F.sum(F.abs("delta"))).first()
        if not n or k and s[1] < tolerance:
            break
        who = state if s[0] > 0.6 * m else state.where("act")
        out = who.where("deg > 0").select(F.col("id").alias("src"), q(F.col("delta") / F.col("deg")).alias("c"))
        z = graph.edges.join(out, "src").groupBy("dst").agg(F.sum("c").alias("z")).withColumnRenamed("dst", "id")
        got = state.join(z, "id", "left").withColumn("d", damping * F.coalesce("z", F.lit(0.0)))
        if k == 0:
            got = got.withColumn("d", F.col("d") + (1 - damping) / n).withColumn("x", F.col("x") + F.col("d")).withColumn("delta", F.col("d") - 1.0 / n).withColumn("act", F.abs("delta") > 0.01 * F.col("x"))
        else:
            got = got.withColumn("delta", F.col("d")).withColumn("act", F.abs("delta") > 0.01 * F.col("x")).withColumn("x", F.when(F.col("act"), F.col("x") + F.col("delta")).otherwise(F.col("x")))
        state = written(got.select("id", "deg", "x", "delta", "act"), instead_of=state)
    total = state.agg(F.sum(F.abs("x"))).first()[0] or 1.0
    return state.select("id", (F.col("x") / total).alias("x"))


def betweenness(graph: Graph, source: int) -> DataFrame:
    """``(id, paths, dependency)``: shortest paths from one source and the dependency on each vertex; nulls where unreached."""
    levels = written(bfs(graph, source).select("id", "level"))
    top = levels.agg(F.max("level")).first()[0]
    if top is None:
        return levels.select("id", F.lit(None).cast("double").alias("paths"), F.lit(None).cast("double").alias("dependency"))
    ls, ld = levels.toDF("src", "ls"), levels.toDF("dst", "ld")
    dag = written(graph.edges.select("src", "dst").join(ls, "src").join(ld, "dst").where("ld = ls + 1"))
    paths = written(levels.where("level = 0").select("id", F.lit(1.0).alias("paths")))
    for k in range(1, top + 1):
        step = dag.where(F.col("ld") == k).join(paths.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        paths = written(paths.union(step))
    dep = written(levels.join(paths, "id").where(F.col("level") == top).select("id", "paths", F.lit(0.0).alias("dependency")))
    for k in range(top - 1, -1, -1):
        own = levels.join(paths, "id").where(F.col("level") == k).select("id", "paths")
        below = dag.where(F.col("ls") == k).join(dep.select(F.col("id").alias("dst"), ((1 + F.col("dependency")) / F.col("paths")).alias("share")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        dep = written(dep.union(own.join(below, "id", "left").select("id", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("dependency"))))
    return graph.vertices.select("id").join(dep, "id", "left")


def belief_propagation(graph: Graph, prior: DataFrame, coupling: tuple = ((0.9, 0.1), (0.1, 0.9)), rounds: int = 10) -> DataFrame:
    """``(id, b0, b1)``: beliefs in two states after ``rounds`` rounds of products of messages, each scaled to a sum of one. ``prior`` is (id, p0, p1)."""
    state = written(prior.select("id", F.col("p0").alias("b0"), F.col("p1").alias("b1"), "p0", "p1"))
    (a, b), (c, d) = coupling
    for _ in range(rounds):
        m0, m1 = a * F.col("b0") + c * F.col("b1"), b * F.col("b0") + d * F.col("b1")
        sent = graph.edges.join(state.select(F.col("id").alias("src"), F.log(m0 / (m0 + m1)).alias("l0"), F.log(m1 / (m0 + m1)).alias("l1")), "src")
        got = sent.groupBy(F.col("dst").alias("id")).agg(F.sum("l0").alias("s0"), F.sum("l1").alias("s1"))
        w = state.join(got, "id", "left").withColumn("odds", (F.log("p1") + F.coalesce("s1", F.lit(0.0))) - (F.log("p0") + F.coalesce("s0", F.lit(0.0))))
        state = written(w.select("id", (1 / (1 + F.exp("odds"))).alias("b0"), (1 / (1 + F.exp(-F.col("odds")))).alias("b1"), "p0", "p1"), instead_of=state)
    return state.select("id", "b0", "b1")


def sketch_mask(i: Column) -> Column:
    """One bit of 32 for a vertex, bit k with chance 2^-(k+1), by an arithmetic hash that SQL engines share."""
    h = (i * 2654435761 + 40503) % 4294967296
    h = (h + F.shiftrightunsigned(h, 15) * 73244475) % 4294967296
    return F.when(h == 0, F.lit(1 << 31).cast("long")).otherwise(h.bitwiseAND(F.bitwise_not(h) + 1))


def radius(graph: Graph, max_rounds: int = 256) -> DataFrame:
    """``(iteration, n_changed, neighbourhood)``: Flajolet-Martin sketches spread until stable; how many changed, and the estimate of vertex pairs within that many hops."""
    spark = graph.edges.sparkSession
    state = written(graph.vertices.select("id", sketch_mask(F.col("id")).alias("mask"), F.lit(True).alias("changed")))
    out = []
    lowest = F.bit_count(F.col("mask").bitwiseXOR(F.col("mask") + 1)) - 1
    for k in range(max_rounds):
        n, size = state.agg(F.sum(F.col("changed").cast("long")), F.sum(F.pow(F.lit(2.0), lowest) / 0.77351)).first()
        out.append((k, n or 0, size or 0.0))
        if not n:
            break
        got = graph.edges.join(state.where("changed").select(F.col("id").alias("src"), "mask"), "src").groupBy(F.col("dst").alias("id")).agg(F.bit_or("mask").alias("got"))
        new = F.col("mask").bitwiseOR(F.coalesce("got", F.lit(0)))
        state = written(state.join(got, "id", "left").select("id", new.alias("mask"), (new != F.col("mask")).alias("changed")), instead_of=state)
    return spark.createDataFrame(out, "iteration long, n_changed long, neighbourhood double")


def effective_diameter(rounds: list[tuple[int, int, float]], share: float = 0.9) -> float:
    """The hops within which ``share`` of reachable pairs are, interpolated over rows of ``radius``."""
    goal = share * rounds[-1][2]
    for (k, _, a), (_, _, b) in zip(rounds, rounds[1:], strict=False):
        if b >= goal > a:
            return k + (goal - a) / (b - a)
    return 0.0
