"""Graphs as two DataFrames, and relational transforms of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridge.runtime import dealt, ranked, written


@dataclass
class Graph:
    """``vertices`` (id, ...) with every vertex, isolated ones too, and ``edges`` (src, dst[, weight]). ``rows``: how many edge rows there are at most, if known; a lazy graph's shuffles are dealt by it."""

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False
    rows: int = 0

    @classmethod
    def of_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, symmetric: bool = False, rows: int = 0) -> Graph:
        """A graph of ``edges``; without ``vertices``, those are the endpoints."""
        ends = edges.select(F.col("src").alias("id"))
        ends = (ends if symmetric else ends.union(edges.select("dst"))).distinct()
        return cls(ends if vertices is None else vertices, edges, symmetric, rows)

    def saved(self) -> Graph:
        """The graph with both tables written, for iteration."""
        return Graph(written(self.vertices), written(self.edges), self.symmetric)

    def transpose(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.symmetric)

    def symmetrise(self) -> Graph:
        """Every edge in both directions, once; of weights the smaller."""
        back = F.coalesce(F.col("dst") < F.col("src"), F.col("dst").isNull() & F.col("src").isNotNull())
        ends = {"src": F.when(back, F.col("dst")).otherwise(F.col("src")), "dst": F.when(back, F.col("src")).otherwise(F.col("dst"))}
        return Graph(self.vertices, both_ways(_merged(self.edges.withColumns(ends), self.rows)), True, 2 * self.rows)

    def without_self_edges(self) -> Graph:
        return Graph(self.vertices, self.edges.where("src <> dst"), self.symmetric)

    def without_duplicates(self) -> Graph:
        return Graph(self.vertices, _merged(self.edges, self.rows), self.symmetric, self.rows)

    def without_isolated(self) -> Graph:
        """Without vertices that have neither in- nor out-edges."""
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()
        return Graph(self.vertices.join(ends, "id", "left_semi"), self.edges, self.symmetric)

    def cleaned(self) -> tuple[Graph, DataFrame]:
        """Without self-edges and isolated vertices, renumbered from 0 in order of id; and the map (old_id, new_id)."""
        kept = self.without_self_edges().without_isolated()
        ids = written(ranked(kept.vertices.select(F.col("id").alias("old_id")), [F.col("old_id")], "new_id"))
        return kept.relabelled(ids), ids

    def relabelled(self, ids: DataFrame) -> Graph:
        """Ids mapped by ``ids`` (old_id, new_id); what it doesn't map goes."""
        s, d = ids.toDF("src", "s"), ids.toDF("dst", "d")
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        edges = self.edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest)
        more = [c for c in self.vertices.columns if c != "id"]
        vertices = self.vertices.join(ids, F.col("id") == F.col("old_id")).select(F.col("new_id").alias("id"), *more)
        return Graph(vertices, edges, self.symmetric)

    def union(self, other: Graph) -> Graph:
        return Graph(self.vertices.select("id").union(other.vertices.select("id")).distinct(), self.edges.select("src", "dst").union(other.edges.select("src", "dst")).distinct(), self.symmetric and other.symmetric)

    def intersect(self, other: Graph) -> Graph:
        return Graph(self.vertices, self.edges.select("src", "dst").intersect(other.edges.select("src", "dst")), self.symmetric and other.symmetric)

    def subtract(self, other: Graph) -> Graph:
        return Graph(self.vertices, self.edges.select("src", "dst").subtract(other.edges.select("src", "dst")), self.symmetric and other.symmetric)

    def induced(self, ids: DataFrame) -> Graph:
        """The subgraph of the vertices in ``ids`` (id)."""
        edges = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(self.vertices.join(ids, "id", "left_semi"), edges, self.symmetric)

    def induced_density(self, ids: DataFrame) -> DataFrame:
        """``(n, m, density)`` of an induced subgraph."""
        sub = self.induced(ids)
        n, m = sub.vertices.agg(F.count("*").alias("n")), sub.edges.agg(F.count("*").alias("m"))
        return n.crossJoin(m).select("n", "m", F.coalesce(F.try_divide(F.col("m").cast("double"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"))

    def attached_edges(self, ids: DataFrame) -> DataFrame:
        """``m``: out-edges of the vertices in ``ids``."""
        return self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count("*").alias("m"))

    def degrees(self) -> DataFrame:
        """``(id, out_deg, in_deg)`` of every vertex, from one shuffle of edge ends."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("dst", F.lit(0), F.lit(1))).union(self.vertices.select("id", F.lit(0), F.lit(0)))
        return ends.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))

    def max_degree(self) -> DataFrame:
        """``(id, out_deg)`` of the smallest id among those of largest out-degree."""
        best = self.degrees().agg(F.max(F.struct("out_deg", (-F.col("id")).alias("neg"))).alias("b"))
        return best.select((-F.col("b.neg")).alias("id"), F.col("b.out_deg").alias("out_deg"))

    def has_edges(self, pairs: DataFrame, negate: bool = False) -> DataFrame:
        """Those of ``pairs`` (src, dst) that are edges, or with ``negate`` aren't."""
        return pairs.join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti" if negate else "left_semi")

    def inverse_edges(self) -> DataFrame:
        """``(eid, inverse)`` for edges with an ``eid`` column."""
        a = self.edges.select("src", "dst", "eid")
        b = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("eid").alias("inverse"))
        return a.join(b, ["src", "dst"]).select("eid", "inverse")

    def missing_reverses(self) -> DataFrame:
        """``n_missing_reverse``: edges without their reverse; zero for an undirected graph."""
        own = self.edges.select("src", "dst").distinct()
        return own.join(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").agg(F.count("*").alias("n_missing_reverse"))

    def difference(self, other: Graph) -> DataFrame:
        """``n_diff``: edge rows in one graph only, with multiplicity; zero for equal graphs."""
        a, b = self.edges.select("src", "dst"), other.edges.select("src", "dst")
        return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("n_diff"))

    def check(self) -> DataFrame:
        """``(n, m, n_self, n_dup, n_isolated, n_outside)`` for a look at a graph's integrity."""
        pairs = self.edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
        e = pairs.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("k")).otherwise(0)), F.lit(0)).alias("n_self"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_dup"))
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct().withColumn("e", F.lit(1))
        v = self.vertices.select("id").withColumn("v", F.lit(1)).join(ends, "id", "full").agg(F.count("v").alias("n"), F.count(F.when(F.col("e").isNull(), 1)).alias("n_isolated"), F.count(F.when(F.col("v").isNull(), 1)).alias("n_outside"))
        return v.crossJoin(e).select("n", "m", "n_self", "n_dup", "n_isolated", "n_outside")

    def sample_vertices(self, k: int = 10, seed: int = 0) -> DataFrame:
        """``k`` distinct vertices that have out-edges, by hashed id: ``(id, out_deg)``."""
        mixed = ((F.col("id") + seed) % 1_000_003 * 2_654_435_761 + 40_503) % 4_294_967_296
        return self.degrees().where("out_deg > 0").orderBy(mixed, "id").limit(k).select("id", "out_deg")

    def prune(self, least: int) -> Graph:
        """Without vertices of out-degree under ``least``, in one pass."""
        return self.induced(self.degrees().where(F.col("out_deg") >= least).select("id"))

    def common_neighbours(self) -> DataFrame:
        """``(src, dst, n_common)``: how many out-neighbours the ends of each edge share, zero too. The end of smaller out-degree is expanded, so a hub's edges cost its partners' degrees."""
        e = self.edges.select("src", "dst")
        deg = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
        sized = e.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
        small = F.when(F.col("ds") <= F.col("dd"), F.col("src")).otherwise(F.col("dst"))
        ends = sized.select("src", "dst", small.alias("u"), F.when(small == F.col("src"), F.col("dst")).otherwise(F.col("src")).alias("w"))
        wedges = ends.join(e.select(F.col("src").alias("u"), F.col("dst").alias("x")), "u").join(e.select(F.col("src").alias("w"), F.col("dst").alias("x")), ["w", "x"]).groupBy("src", "dst").agg(F.count("*").alias("k"))
        return e.join(wedges, ["src", "dst"], "left").select("src", "dst", F.coalesce("k", F.lit(0)).alias("n_common"))

    def with_weights(self) -> Graph:
        """Edges with the generated weights 64 to 191, the same in both directions."""
        return Graph(self.vertices, self.edges.withColumn("weight", generated_weight(F.col("src"), F.col("dst")).cast("double")), self.symmetric)


def generated_weight(src: Column, dst: Column) -> Column:
    return F.lit(64) + (src + dst).bitwiseAND(F.lit(127))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each row of ``edges`` (src, dst, ...) and its reverse, but a self-edge once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there, back = F.struct("src", "dst", *rest), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.select(F.inline(F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(there)).otherwise(F.array(there, back))))


def _merged(edges: DataFrame, rows: int = 0) -> DataFrame:
    if "weight" in edges.columns:
        return dealt(edges, rows, "src", "dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return dealt(edges.select("src", "dst"), rows, "src", "dst").distinct()
