"""The higher-order operators over graphs: edge map, vertex map, scan and filter, flat edge map, and frontiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridge.graph import Graph
from veridge.operators.reducers import Reducer


class Frontier:
    """A set of vertices; ``ids`` is None for all of them, which costs no join."""

    def __init__(self, ids: DataFrame | None = None) -> None:
        self.ids = ids

    @classmethod
    def all(cls) -> Frontier:
        return cls()

    @classmethod
    def of(cls, spark, *ids: int) -> Frontier:
        return cls(spark.createDataFrame([(i,) for i in ids], "id long"))

    def rows(self, graph: Graph) -> DataFrame:
        return graph.vertices.select("id") if self.ids is None else self.ids

    def union(self, other: Frontier) -> Frontier:
        return Frontier(None if self.ids is None or other.ids is None else self.ids.union(other.ids).distinct())

    def filter(self, vertices: DataFrame, pred: Column) -> Frontier:
        kept = vertices.where(pred)
        return Frontier((kept if self.ids is None else kept.join(self.ids, "id", "left_semi")).select("id"))

    def counts(self, graph: Graph) -> DataFrame:
        """``(nactv, nacte, density)``: active vertices, their out-edges, and both against all edges."""
        act = self.rows(graph).agg(F.count("*").alias("nactv"))
        e = graph.edges if self.ids is None else graph.edges.join(self.ids.select(F.col("id").alias("src")), "src", "left_semi")
        both = act.crossJoin(e.agg(F.count("*").alias("nacte"))).crossJoin(graph.edges.agg(F.count("*").alias("m")))
        return both.select("nactv", "nacte", F.coalesce(F.try_divide((F.col("nactv") + F.col("nacte")).cast("double"), F.col("m")), F.lit(0.0)).alias("density"))

    def intersect(self, other: Frontier) -> Frontier:
        if self.ids is None or other.ids is None:
            return Frontier(other.ids if self.ids is None else self.ids)
        return Frontier(self.ids.join(other.ids, "id", "left_semi"))

    def difference(self, graph: Graph, other: Frontier) -> Frontier:
        """Vertices of this frontier that aren't in the other; none are if that has all."""
        own = self.rows(graph)
        return Frontier(own.where(F.lit(False)) if other.ids is None else own.join(other.ids, "id", "left_anti"))

    def split(self, graph: Graph, left: Frontier, right: Frontier) -> DataFrame:
        """``(id, part)``: 0 for vertices only in ``left``, 1 for those only in ``right``, 2 for those in both; others of this frontier aren't listed."""
        mark = lambda f, name: f.rows(graph).distinct().withColumn(name, F.lit(True))
        rows = self.rows(graph).join(mark(left, "l"), "id", "left").join(mark(right, "r"), "id", "left").where("l or r")
        return rows.select("id", F.when(F.col("l") & F.col("r"), 2).when(F.col("l"), 0).otherwise(1).alias("part"))

    def is_subset(self, graph: Graph, other: Frontier) -> DataFrame:
        """``(n_outside, is_subset)``."""
        return self.difference(graph, other).rows(graph).agg(F.count("*").alias("n_outside")).withColumn("is_subset", F.col("n_outside") == 0)

    def is_empty(self, graph: Graph) -> bool:
        return not self.rows(graph).take(1)

    def contains(self, ids: DataFrame) -> DataFrame:
        return ids if self.ids is None else ids.join(self.ids, "id", "left_semi")


def edgemap(
    graph: Graph,
    relax: Callable[[Callable, Callable, Callable], Column],
    reducer: Reducer,
    value: str = "value",
    src_frontier: Frontier | None = None,
    dst_frontier: Frontier | None = None,
    dst_filter: Column | None = None,
    record: str = "reduction",
    method: Callable[[Column, Column], Column] | None = None,
    weak: bool = False,
) -> DataFrame:
    """Relax every edge that passes the filters: ``(id, old, value, changed, touched)`` for every vertex.

    ``relax(s, d, e)`` makes a message from ``s(name)``, ``d(name)`` and ``e(name)``, columns of the edge's ends and the edge; messages are summed up by ``reducer`` and met with the column ``value`` of the vertices. Vertex columns that the message doesn't use are pruned, so a join to the destination's row only happens if it does. ``weak`` filters may be left out, and are. ``dst_filter`` is over vertex columns; true keeps. ``record`` says what counts as changed: ``all``, ``reduction`` (as the reducer has it), ``method`` (``method(old, new)``, only where a message came), or ``either``.
    """
    v, edges = graph.vertices, graph.edges
    if src_frontier is not None and src_frontier.ids is not None and not weak:
        edges = edges.join(src_frontier.ids.select(F.col("id").alias("src")), "src", "left_semi")
    if dst_frontier is not None and dst_frontier.ids is not None and not weak:
        edges = edges.join(dst_frontier.ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    if dst_filter is not None:
        edges = edges.join(v.where(dst_filter).select(F.col("id").alias("dst")), "dst", "left_semi")
    used: dict[str, set] = {"s": set(), "d": set()}

    def side(k: str) -> Callable[[str], Column]:
        def name(c: str) -> Column:
            if c == "id":
                return F.col("src" if k == "s" else "dst")
            used[k].add(c)
            return F.col(f"__{k}_{c}")

        return name

    message = relax(side("s"), side("d"), lambda c: F.col(c))
    for k, key in (("s", "src"), ("d", "dst")):
        if used[k]:
            edges = edges.join(v.select(F.col("id").alias(key), *(F.col(c).alias(f"__{k}_{c}") for c in sorted(used[k]))), key)
    got = edges.select(F.col("dst").alias("id"), message.alias("__m")).groupBy("id").agg(reducer.agg(F.col("__m")).alias("__got"), F.lit(True).alias("__hit"))
    old = F.col("__old")
    new = v.select("id", F.col(value).alias("__old")).join(got, "id", "left").withColumn("__new", reducer.combine(old, F.col("__got")))
    touched = F.coalesce(F.col("__hit"), F.lit(False))
    by_reduction = touched & F.coalesce(reducer.changed(old, F.col("__new")), F.lit(False))
    by_method = touched & F.coalesce(method(old, F.col("__new")), F.lit(False)) if method else F.lit(False)
    changed = {"all": F.lit(True), "reduction": by_reduction, "method": by_method, "either": by_reduction | by_method}[record]
    return new.select("id", old.alias("old"), F.col("__new").alias("value"), changed.alias("changed"), touched.alias("touched"))


def changed_frontier(result: DataFrame) -> Frontier:
    return Frontier(result.where("changed").select("id"))


def vertex_map(graph: Graph, frontier: Frontier | None = None, **columns: Column) -> Graph:
    """Vertices with columns set, in the frontier only; elsewhere they keep their value, or null if new."""
    v = graph.vertices
    if frontier is None or frontier.ids is None:
        return Graph(v.withColumns(columns), graph.edges, graph.symmetric)
    act = v.join(frontier.ids.withColumn("__act", F.lit(True)), "id", "left")
    put = {c: F.when(F.col("__act"), x).otherwise(F.col(c) if c in v.columns else F.lit(None)) for c, x in columns.items()}
    return Graph(act.withColumns(put).drop("__act"), graph.edges, graph.symmetric)


def vertex_scan(graph: Graph, *aggregates: Column, frontier: Frontier | None = None) -> DataFrame:
    return (frontier or Frontier()).contains(graph.vertices).agg(*aggregates)


def vertex_filter(graph: Graph, pred: Column, frontier: Frontier | None = None) -> Frontier:
    return (frontier or Frontier()).filter(graph.vertices, pred)


def flat_edge_map(graph: Graph, *columns: Column) -> DataFrame:
    """Columns of the bare edges; with aggregates, one row."""
    return graph.edges.select(*columns)
