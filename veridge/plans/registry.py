"""Named queries over the driver's tables, and the SQL that they equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridge.functions import scalar
from veridge.graph import Graph, both_ways
from veridge.operators import cliques, edgemap as em, hoeffding as ho, reducers as red, statistics as st, structure as sg, traversal as tr
from veridge.runtime import dealt, ranked, shared_dir, table, written
from veridge.sources import formats as fm

BASE = 1_000_000_000
SQL_GRAPHS = {
    "purchase": f"SELECT DISTINCT o_custkey AS src, {BASE} + l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "supply": f"SELECT DISTINCT l_suppkey AS src, {BASE} + l_partkey AS dst FROM lineitem",
    "copurchase": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey",
    "copurchase2": "SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2",
    "transition": "SELECT DISTINCT u AS src, v AS dst FROM (SELECT user_id AS u, lead(user_id) OVER (ORDER BY ts, event_id) AS v FROM events) WHERE v IS NOT NULL",
}


def _copurchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of each order's pairs of parts, src < dst, dealt by pair. Their number is foretold by the orders' average of lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n, orders = lines.agg(F.count("*"), F.approx_count_distinct("l_orderkey")).first()
    own = dealt(lines, n, "l_orderkey").distinct()
    pairs = own.withColumnRenamed("l_partkey", "src").join(own.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src < dst").select("src", "dst")
    return dealt(pairs, n * n // (2 * max(orders, 1)), "src", "dst")


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next event's user over all time. The order is global, so events are ranked in parallel and met with the next rank."""
    rows = written(ranked(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), [F.col("ts"), F.col("event_id")], "r").select("r", "user_id"))
    return rows.select("r", F.col("user_id").alias("src")).join(rows.select((F.col("r") - 1).alias("r"), F.col("user_id").alias("dst")), "r").select("src", "dst").distinct()


def graph(spark: SparkSession, sf_dir: str, name: str, saved: bool = True) -> Graph:
    """A graph of the driver's tables; ``saved`` writes it, for queries that read it more than once or twice."""
    rows = 0
    if name == "purchase":
        o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
        rows = li.count()
        both = rows + o.count()
        bought = dealt(o.select("o_orderkey", "o_custkey"), both, "o_orderkey").join(dealt(li.select("l_orderkey", "l_partkey"), both, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        edges = dealt(bought.select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + BASE).alias("dst")), rows, "src", "dst").distinct()
    elif name == "supply":
        li = table(spark, sf_dir, "lineitem")
        rows = li.count()
        edges = dealt(li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + BASE).alias("dst")), rows, "src", "dst").distinct()
    elif name == "copurchase":
        edges = both_ways(_copurchases(spark, sf_dir).distinct())
    elif name == "copurchase2":
        edges = both_ways(_copurchases(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("k")).where("k >= 2").select("src", "dst"))
    else:
        edges = _transitions(spark, sf_dir)
    if not saved:
        return Graph.of_edges(edges, symmetric=name.startswith("copurchase"), rows=rows)
    edges = written(edges)
    return Graph(written(Graph.of_edges(edges, symmetric=name.startswith("copurchase")).vertices), edges, name.startswith("copurchase"))


_Q: dict[str, Callable] = {}
#: Queries that read their graph once, so that writing it first would only cost.
_ONCE = {"graph_transpose", "graph_symmetrise", "graph_rm_self", "graph_weights", "graph_max_degree", "flat_edge_map", "edge_weight_profile", "vertex_filter", "vertex_scan", "degree_stats", "graph_degree", "degree_pdf"}
_SQL: dict[str, str] = {}


def _query(name: str, on: str | None = None, sql: str | None = None):
    """Registers a function of a graph, or of (spark, sf_dir); ``sql`` may use the graph's edges as ``e`` and its vertices as ``v``."""

    def put(f):
        _Q[name] = (lambda spark, sf_dir: f(graph(spark, sf_dir, on, name not in _ONCE))) if on else f
        if sql:
            text = sql.strip()
            if on:
                head = f"WITH RECURSIVE e AS MATERIALIZED ({SQL_GRAPHS[on]}), v AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))"
                text = head + (", " + text[4:].lstrip() if text.startswith("WITH") else " " + text)
            _SQL[name] = text
        return f

    return put


# -- transforms -------------------------------------------------------------------------------------------------------------------
_query("graph_degree", "purchase", "SELECT v.id, coalesce(o, 0) AS out_deg, coalesce(i, 0) AS in_deg FROM v LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY 1) a ON a.src = v.id LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY 1) b ON b.dst = v.id")(lambda g: g.degrees())
_query("graph_max_degree", "purchase", "SELECT src AS id, count(*) AS out_deg FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(lambda g: g.max_degree())
_query("graph_transpose", "supply", "SELECT dst AS src, src AS dst FROM e")(lambda g: g.transpose().edges)
_query("graph_symmetrise", "supply", "SELECT src, dst FROM e UNION SELECT dst, src FROM e")(lambda g: g.symmetrise().edges)
_query("graph_rm_self", "transition", "SELECT src, dst FROM e WHERE src <> dst")(lambda g: g.without_self_edges().edges)
_query("graph_clean_renumber", "transition", "SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM (SELECT DISTINCT id FROM (SELECT src AS id FROM e WHERE src <> dst UNION ALL SELECT dst FROM e WHERE src <> dst))")(lambda g: g.cleaned()[1])
_query("graph_clean_edges", "transition", "WITH m AS (SELECT id AS o, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT id FROM (SELECT src AS id FROM e WHERE src <> dst UNION ALL SELECT dst FROM e WHERE src <> dst))) SELECT a.k AS src, b.k AS dst FROM e JOIN m a ON a.o = src JOIN m b ON b.o = dst WHERE src <> dst")(lambda g: g.cleaned()[0].edges)
_query("graph_is_undirected", "transition", "SELECT count(*) AS n_missing_reverse FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.src = b.dst AND a.dst = b.src)")(lambda g: g.missing_reverses())
_query("graph_check", "transition", "SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM e WHERE src = dst) AS n_self, (SELECT count(*) - count(DISTINCT (src, dst)) FROM e) AS n_dup, CAST(0 AS BIGINT) AS n_isolated, CAST(0 AS BIGINT) AS n_outside")(lambda g: g.check())
_query("graph_equal", "supply", "SELECT count(*) AS n_diff FROM (SELECT src, dst FROM e EXCEPT SELECT src, dst FROM e)")(lambda g: g.difference(g.transpose().transpose()))
_query("graph_weights", "supply", "SELECT src, dst, CAST(64 + ((src + dst) & 127) AS DOUBLE) AS weight FROM e")(lambda g: g.with_weights().edges)
_query("graph_inverse_edges", "copurchase2", "WITH w AS (SELECT src, dst, src * 1000000 + dst AS eid FROM e) SELECT a.eid, b.eid AS inverse FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src")(lambda g: Graph(g.vertices, g.edges.withColumn("eid", F.col("src") * 1_000_000 + F.col("dst"))).inverse_edges())
_query("graph_prune_degree", "copurchase2", "WITH d AS (SELECT src AS id FROM e GROUP BY 1 HAVING count(*) >= 4) SELECT src, dst FROM e WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)")(lambda g: g.prune(4).edges)
_query("graph_rnd_select", "copurchase2", "SELECT src AS id, count(*) AS out_deg FROM e GROUP BY 1 ORDER BY (src % 1000003 * 2654435761 + 40503) % 4294967296, 1 LIMIT 10")(lambda g: g.sample_vertices())
_query("graph_differs", "transition", "WITH p AS (SELECT src, dst FROM e WHERE src <> dst) SELECT count(*) AS n_diff FROM ((SELECT src, dst FROM e EXCEPT SELECT src, dst FROM p) UNION ALL (SELECT src, dst FROM p EXCEPT SELECT src, dst FROM e))")(lambda g: g.difference(g.without_self_edges()))


@_query("graph_dedup", sql="SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def _dedup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return Graph.of_edges(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), rows=li.count()).without_duplicates().edges


def _by_year(spark, sf_dir) -> tuple[Graph, Graph]:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), (F.year("o_orderdate") % 2).alias("odd"))
    return tuple(Graph.of_edges(rows.where(F.col("odd") == k).select("src", "dst").distinct()) for k in (0, 1))


for _op, _f in (("union", Graph.union), ("intersect", Graph.intersect), ("except", Graph.subtract)):
    _sides = ["SELECT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE year(o_orderdate) % 2 = " + k for k in "01"]
    _query(f"graph_{_op}", sql=f"{_sides[0]} {_op.upper()} {_sides[1]}")(lambda spark, sf_dir, f=_f: f(*_by_year(spark, sf_dir)).edges)

_PAIRS = "SELECT id AS src, id + 1 AS dst FROM v"
for _name, _not in (("semi", ""), ("anti", "NOT ")):
    _query(f"edge_membership_{_name}", "copurchase2", f"SELECT src, dst FROM ({_PAIRS}) p WHERE {_not}EXISTS (SELECT 1 FROM e WHERE e.src = p.src AND e.dst = p.dst)")(lambda g, k=bool(_not): g.has_edges(g.vertices.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), k))
_query("induced_subgraph_density", "copurchase2", "WITH n AS (SELECT count(*) AS n FROM v WHERE id < 500), m AS (SELECT count(*) AS m FROM e WHERE src < 500 AND dst < 500) SELECT n, m, CASE WHEN n > 1 THEN m / CAST(n * (n - 1) AS DOUBLE) ELSE 0.0 END AS density FROM n, m")(lambda g: g.induced_density(g.vertices.where("id < 500").select("id")))
_query("attached_edges", "copurchase2", "SELECT count(*) AS m FROM e WHERE src < 500")(lambda g: g.attached_edges(g.vertices.where("id < 500").select("id")))
_query("adjacency_intersect_size", "copurchase2", "SELECT e.src, e.dst, (SELECT count(*) FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = e.src AND b.src = e.dst) AS n_common FROM e")(lambda g: g.common_neighbours())

# -- edge maps: messages s mod 16 + 1 onto the value d mod 8 ------------------------------------------------------------------------
_OLD, _MSG = "id % 8", "src % 16 + 1"


def _valued(g: Graph) -> Graph:
    return em.vertex_map(g, value=F.col("id") % 8, weight=F.col("id") % 16 + 1)


def _mapped(g: Graph, reducer: red.Reducer, **more) -> DataFrame:
    return em.edgemap(_valued(g), lambda s, d, e: s("weight"), reducer, **more)


_AGG = {"min": ("min", "least(old, got)", red.MIN), "max": ("max", "greatest(old, got)", red.MAX), "sum": ("sum", "old + got", red.SUM), "bit_or": ("bit_or", "old | got", red.BIT_OR), "bit_and": ("bit_and", "old & got", red.BIT_AND)}


def _edgemap_sql(agg: str, combine: str, changed: str, where: str = "", old: str = _OLD) -> str:
    return f"WITH g AS (SELECT dst, CAST({agg} AS BIGINT) AS got FROM e {where} GROUP BY 1), n AS (SELECT v.id, {old} AS old, got, CASE WHEN got IS NULL THEN {old} ELSE {combine.replace('old', f'({old})')} END AS value FROM v LEFT JOIN g ON g.dst = v.id) SELECT id, CAST(value AS BIGINT) AS value, got IS NOT NULL AND {changed} AS changed FROM n"


for _k, (_a, _c, _r) in _AGG.items():
    _query(f"edgemap_{_k}", "purchase", _edgemap_sql(f"{_a}({_MSG})", _c, "true" if _k == "sum" else "value <> old"))(lambda g, r=_r: _mapped(g, r).select("id", "value", "changed"))
for _k, _r in (("or", red.OR), ("and", red.AND)):
    _c = {"or": "old OR got", "and": "old AND got"}[_k]
    _query(f"edgemap_{_k}", "purchase", f"WITH g AS (SELECT dst, bool_{_k}(src % 3 = 0) AS got FROM e GROUP BY 1) SELECT id, CASE WHEN got IS NULL THEN id % 2 = 0 ELSE {_c.replace('old', '(id % 2 = 0)')} END AS value FROM v LEFT JOIN g ON dst = id")(lambda g, r=_r: em.edgemap(em.vertex_map(g, value=F.col("id") % 2 == 0), lambda s, d, e: s("id") % 3 == 0, r).select("id", "value"))
_query("edgemap_mul", "supply", "WITH g AS (SELECT dst, product(CASE WHEN src % 2 = 0 THEN 2.0 ELSE 0.5 END) AS got FROM e GROUP BY 1) SELECT id, CAST(coalesce(got, 1.0) AS DOUBLE) AS value FROM v LEFT JOIN g ON dst = id")(lambda g: em.edgemap(em.vertex_map(g, value=F.lit(1.0)), lambda s, d, e: F.when(s("id") % 2 == 0, 2.0).otherwise(0.5), red.PRODUCT).select("id", "value"))
_query("edgemap_count_down", "purchase", _edgemap_sql("count(*)", "CASE WHEN old <= 3 THEN old ELSE greatest(3, old - got) END", "old > 3 AND value = 3"))(lambda g: _mapped(g, red.count_down(3)).select("id", "value", "changed"))
_query("edgemap_setif", "purchase", "WITH g AS (SELECT dst, min(src) AS got FROM e GROUP BY 1), n AS (SELECT id, CASE WHEN id % 3 = 0 THEN id END AS old, got FROM v LEFT JOIN g ON dst = id) SELECT id, coalesce(old, got) AS value, old IS NULL AND got IS NOT NULL AS changed FROM n")(lambda g: em.edgemap(em.vertex_map(g, value=F.when(F.col("id") % 3 == 0, F.col("id"))), lambda s, d, e: s("id"), red.SET_IF_UNSET).select("id", "value", "changed"))
_query("edgemap_filter_src_frontier", "purchase", _edgemap_sql(f"max({_MSG})", "greatest(old, got)", "value <> old", "WHERE src % 5 = 0"))(lambda g: _mapped(g, red.MAX, src_frontier=em.vertex_filter(g, F.col("id") % 5 == 0)).select("id", "value", "changed"))
_query("edgemap_filter_dst_frontier", "purchase", _edgemap_sql(f"max({_MSG})", "greatest(old, got)", "value <> old", "WHERE dst % 5 = 0"))(lambda g: _mapped(g, red.MAX, dst_frontier=em.vertex_filter(g, F.col("id") % 5 == 0)).select("id", "value", "changed"))
_query("edgemap_filter_dst_predicate", "purchase", _edgemap_sql(f"max({_MSG})", "greatest(old, got)", "value <> old", "WHERE dst % 8 > 4"))(lambda g: _mapped(g, red.MAX, dst_filter=F.col("value") > 4).select("id", "value", "changed"))
_query("edgemap_record_reduction", "purchase", f"SELECT dst AS id FROM e GROUP BY 1 HAVING max({_MSG}) > dst % 8")(lambda g: em.changed_frontier(_mapped(g, red.MAX)).ids)
_query("edgemap_record_method", "purchase", f"SELECT dst AS id FROM e GROUP BY 1 HAVING greatest(dst % 8, max({_MSG})) > 15")(lambda g: em.changed_frontier(_mapped(g, red.MAX, record="method", method=lambda old, new: new > 15)).ids)
_query("edgemap_count_down_value", "purchase", _edgemap_sql(f"sum({_MSG})", "CASE WHEN old <= 3 THEN old ELSE greatest(3, old - got) END", "old > 3 AND value = 3"))(lambda g: _mapped(g, red.count_down_value(3)).select("id", "value", "changed"))
for _k in ("min", "max"):
    _a, _c, _r = _AGG[_k]
    _query(f"edgemap_{_k}_conditional", "purchase", _edgemap_sql(f"{_a}({_MSG})", f"CASE WHEN old > 2 THEN {_c} ELSE old END", "old > 2 AND value <> old"))(lambda g, r=_r: _mapped(g, red.conditional(r, lambda old: old > 2)).select("id", "value", "changed"))
_query("edgemap_assign", "purchase", "WITH g AS (SELECT DISTINCT dst FROM e) SELECT id, CASE WHEN dst IS NULL THEN id % 8 ELSE 7 END AS value FROM v LEFT JOIN g ON dst = id")(lambda g: em.edgemap(_valued(g), lambda s, d, e: F.lit(7).cast("long"), red.ASSIGN).select("id", "value"))
_query("edgemap_record_either", "purchase", f"SELECT dst AS id FROM e GROUP BY 1 HAVING max({_MSG}) > dst % 8 OR greatest(dst % 8, max({_MSG})) % 2 = 0")(lambda g: em.changed_frontier(_mapped(g, red.MAX, record="either", method=lambda old, new: new % 2 == 0)).ids)
_query("edgemap_record_all", "supply", "SELECT id FROM v")(lambda g: em.changed_frontier(_mapped(g, red.MAX, record="all")).ids)
_query("edgemap_filter_weak", "supply", _edgemap_sql(f"max({_MSG})", "greatest(old, got)", "value <> old"))(lambda g: _mapped(g, red.MAX, src_frontier=em.vertex_filter(g, F.col("id") % 5 == 0), weak=True).select("id", "value", "changed"))
_query("edgemap_both_ends", "supply", "WITH g AS (SELECT dst, max(src % 8 * 10 + dst % 8) AS got FROM e GROUP BY 1) SELECT id, greatest(id % 8, coalesce(got, 0)) AS value FROM v LEFT JOIN g ON dst = id")(lambda g: em.edgemap(_valued(g), lambda s, d, e: s("value") * 10 + d("value"), red.MAX).select("id", "value"))
_SETS = lambda g: [em.vertex_filter(g, F.col("id") % k == 0) for k in (2, 3)]
_query("frontier_union", "supply", "SELECT id FROM v WHERE id % 2 = 0 OR id % 3 = 0")(lambda g: (lambda a, b: a.union(b).ids)(*_SETS(g)))
_query("frontier_intersect", "supply", "SELECT id FROM v WHERE id % 2 = 0 AND id % 3 = 0")(lambda g: (lambda a, b: a.intersect(b).ids)(*_SETS(g)))
_query("frontier_difference", "supply", "SELECT id FROM v WHERE id % 2 = 0 AND id % 3 <> 0")(lambda g: (lambda a, b: a.difference(g, b).ids)(*_SETS(g)))
_query("frontier_split", "supply", "SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 2 WHEN id % 2 = 0 THEN 0 ELSE 1 END AS part FROM v WHERE id % 2 = 0 OR id % 3 = 0")(lambda g: em.Frontier.all().split(g, *_SETS(g)))
_query("frontier_subset", "supply", "SELECT count(*) AS n_outside, count(*) = 0 AS is_subset FROM v WHERE id % 2 = 0 AND id % 3 <> 0")(lambda g: (lambda a, b: a.is_subset(g, b))(*_SETS(g)))
_query("vertex_map", "supply", "SELECT id, CASE WHEN id % 2 = 0 THEN id * 2 END AS value FROM v")(lambda g: em.vertex_map(g, em.vertex_filter(g, F.col("id") % 2 == 0), value=F.col("id") * 2).vertices)
_query("vertex_scan", "supply", "SELECT count(*) AS n, CAST(sum(id % 100) AS BIGINT) AS total FROM v")(lambda g: em.vertex_scan(g, F.count("*").alias("n"), F.sum(F.col("id") % 100).alias("total")))
_query("vertex_filter", "supply", "SELECT id FROM v WHERE id % 7 = 3")(lambda g: em.vertex_filter(g, F.col("id") % 7 == 3).ids)
_query("flat_edge_map", "supply", "SELECT count(*) AS m, CAST(sum((src + dst) & 127) AS BIGINT) AS total FROM e")(lambda g: em.flat_edge_map(g, F.count("*").alias("m"), F.sum((F.col("src") + F.col("dst")).bitwiseAND(127)).alias("total")))
_query("frontier_counts", "copurchase2", "WITH a AS (SELECT count(*) AS nactv FROM v WHERE id % 3 = 0), b AS (SELECT count(*) AS nacte FROM e WHERE src % 3 = 0), m AS (SELECT count(*) AS m FROM e) SELECT nactv, nacte, (nactv + nacte) / CAST(m AS DOUBLE) AS density FROM a, b, m")(lambda g: em.vertex_filter(g, F.col("id") % 3 == 0).counts(g))


# -- scans and scalars -----------------------------------------------------------------------------------------------------------
@_query("prefix_sum", sql="SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM orders")
def _prefix(spark, sf_dir):
    return st.prefix_sums(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey").select("o_orderkey", "prefix")


@_query("count_unique", sql="WITH s AS (SELECT l_partkey AS l, count(*) AS k FROM lineitem GROUP BY 1) SELECT count(*) AS n_labels, CAST(sum(k) AS BIGINT) AS n, min(k) AS smallest, max(k) AS largest, (SELECT l FROM s ORDER BY k DESC, l LIMIT 1) AS most_label, (SELECT l FROM s ORDER BY k, l LIMIT 1) AS least_label FROM s")
def _unique(spark, sf_dir):
    return sg.count_unique(table(spark, sf_dir, "lineitem"), "l_partkey")


@_query("find_min_max", sql="SELECT min(l_discount) AS least, max(l_discount) AS most FROM lineitem WHERE l_discount <> 0")
def _minmax(spark, sf_dir):
    return st.find_min_max(table(spark, sf_dir, "lineitem"), "l_discount")


@_query("analyse_range", sql="WITH x AS (SELECT l_linenumber - 2 AS x FROM lineitem) SELECT min(x) AS least, min(x) FILTER (x <> 0) AS least_nonzero, max(x) AS most, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * x) AS BIGINT) AS squares, count(*) FILTER (x < 0) AS n_negative, count(*) FILTER (x = 0) AS n_zero, count(*) FILTER (x > 1) AS n_over_one FROM x")
def _range(spark, sf_dir):
    return st.analyse_range(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 2).alias("x")), "x")


@_query("scalar_bitops", sql="SELECT o_orderkey, o_orderkey & 255 AS b_and, o_orderkey | 255 AS b_or, xor(o_orderkey, 255) AS b_xor, o_orderkey << 3 AS sl, o_orderkey >> 3 AS sr, least(o_orderkey + 10, 1000) AS sat, CAST(bit_count(o_orderkey) AS INTEGER) AS ones FROM orders")
def _bitops(spark, sf_dir):
    x = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.bitwiseAND(F.lit(255)).alias("b_and"), x.bitwiseOR(F.lit(255)).alias("b_or"), x.bitwiseXOR(F.lit(255)).alias("b_xor"), F.shiftleft(x, 3).alias("sl"), F.shiftrightunsigned(x, 3).alias("sr"), scalar.adds(x, F.lit(10), 1000).alias("sat"), F.bit_count(x).alias("ones"))


@_query("scalar_iif_predication", sql="SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 7 ELSE 3 END AS picked, CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS masked, CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE 0 END AS or_zero FROM orders")
def _iif(spark, sf_dir):
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.iif(c % 2 == 0, F.lit(3), F.lit(7)).alias("picked"), scalar.masked(c % 3 == 0, c).alias("masked"), scalar.iforz(c % 3 == 0, c).alias("or_zero"))


@_query("scalar_lzcnt_tzcnt", sql="SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 64 ELSE CAST(64 - length(ltrim(bin(o_orderkey), '0')) AS INTEGER) END AS lz, CASE WHEN o_orderkey = 0 THEN 64 ELSE CAST(bit_count(xor(o_orderkey, o_orderkey - 1)) - 1 AS INTEGER) END AS tz FROM orders")
def _zeros(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.lzcnt(F.col("o_orderkey")).cast("int").alias("lz"), scalar.tzcnt(F.col("o_orderkey")).cast("int").alias("tz"))


@_query("scalar_masks", sql="SELECT o_orderkey, o_custkey & ~255 AS clear, (o_orderkey & o_custkey) = 0 AS apart, (o_orderkey - 500) < 0 AS sign, (o_orderkey - 500) >> 2 AS sra, (o_orderkey * o_custkey) >> 32 AS hi, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey / CAST(o_custkey % 7 AS DOUBLE) END AS quotient, CASE WHEN (o_orderkey & 255) >= 128 THEN (o_orderkey & 255) - 256 ELSE o_orderkey & 255 END AS wrapped FROM orders")
def _masks(spark, sf_dir):
    x, y = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.and_not(F.lit(255).cast("long"), y).alias("clear"), scalar.and_zero(x, y).alias("apart"), scalar.sign_set(x - 500).alias("sign"), scalar.shift_right_signed(x - 500, 2).alias("sra"), scalar.mulhi(x, y).alias("hi"), scalar.try_divide(x.cast("double"), (y % 7).cast("double")).alias("quotient"), scalar.wrapped(x, 8).alias("wrapped"))


@_query("scalar_lists", sql="WITH a AS (SELECT o_orderkey AS k, [o_orderkey % 2 = 0, o_orderkey % 3 = 0, o_orderkey % 5 = 0] AS f FROM orders) SELECT k, CAST(coalesce(list_position(f, false), 4) - 1 AS INTEGER) AS smallest, CAST(coalesce(list_position(f, true), 0) - 1 AS INTEGER) AS first, 2 * k + (k % 4) * (k % 4 - 1) // 2 + k - k AS looped FROM a")
def _lists(spark, sf_dir):
    x = F.col("o_orderkey")
    f = F.array(x % 2 == 0, x % 3 == 0, x % 5 == 0)
    return table(spark, sf_dir, "orders").select(x.alias("k"), scalar.smallest_false(f).alias("smallest"), scalar.find_first(f, lambda b: b).alias("first"), scalar.loop(2 * x, x % 4, lambda v, i: v + i).alias("looped"))


@_query("scalar_compensated_sum", sql="SELECT o_custkey, round(fsum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def _compensated(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_totalprice")).alias("x"))
    return grouped.select("o_custkey", F.round(scalar.compensated_sum(F.col("x")), 4).alias("total"))


_query("scalar_mex", "copurchase2", "WITH u AS (SELECT DISTINCT src AS id, dst % 8 AS c FROM e), k AS (SELECT v.id, x.c FROM v, range(0, 9) x(c)) SELECT k.id, CAST(min(k.c) AS INTEGER) AS mex FROM k LEFT JOIN u ON u.id = k.id AND u.c = k.c WHERE u.id IS NULL GROUP BY 1")(lambda g: g.edges.groupBy(F.col("src").alias("id")).agg(F.collect_set(F.col("dst") % 8).alias("used")).select("id", scalar.mex(F.col("used")).alias("mex")))

# -- traversal and ranking -----------------------------------------------------------------------------------------------------
_LEVELS = "lv(id, level) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.dst, lv.level + 1 FROM lv JOIN e ON e.src = lv.id WHERE lv.level < {cap}), l AS (SELECT id, min(level) AS level FROM lv GROUP BY 1)"
_query("bfs_level", "copurchase", f"WITH {_LEVELS.format(cap=12)} SELECT v.id, level FROM v LEFT JOIN l ON l.id = v.id")(lambda g: tr.bfs(g).select("id", "level"))
_query("bfs_parent", "copurchase", f"WITH {_LEVELS.format(cap=12)} SELECT v.id, CASE WHEN l.level = 0 THEN v.id ELSE (SELECT min(e.src) FROM e JOIN l p ON p.id = e.src WHERE e.dst = v.id AND p.level = l.level - 1) END AS parent FROM v LEFT JOIN l ON l.id = v.id")(lambda g: tr.bfs(g).select("id", "parent"))
_START = "(SELECT min(id) FROM v)"
_SSSP = f"WITH w AS MATERIALIZED (SELECT src, dst, CAST(64 + ((src + dst) & 127) AS DOUBLE) AS weight FROM e), r(i, id, dist) AS (SELECT 0, id, CASE WHEN id = {_START} THEN 0.0::DOUBLE END FROM v UNION ALL SELECT i + 1, id, min(dist) FROM (SELECT i, id, dist FROM r UNION ALL SELECT i, w.dst, r.dist + w.weight FROM r JOIN w ON w.src = r.id WHERE r.dist IS NOT NULL) WHERE i < 40 GROUP BY 1, 2) SELECT id, dist FROM r WHERE i = 40"


def _first(g: Graph) -> int:
    return g.vertices.agg(F.min("id")).first()[0] or 0


_query("sssp", "copurchase2", _SSSP)(lambda g: tr.sssp(g.with_weights(), _first(g)))
_query("sssp_delta", "copurchase2", _SSSP)(lambda g: tr.sssp(g.with_weights(), _first(g), delta=200.0))
_query("edge_weight_profile", "supply", "WITH w AS (SELECT 64 + ((src + dst) & 127) AS w FROM e) SELECT CAST(min(w) AS DOUBLE) AS least, CAST(max(w) AS DOUBLE) AS most, false AS any_negative, false AS any_zero FROM w")(lambda g: tr.edge_profile(g.with_weights().edges))


def _pr_sql(k: int, tail: str, cut: Callable[[str, int], str] = lambda x, i: x) -> str:
    steps = ["p0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS pr FROM v)", "d AS (SELECT src, count(*) AS deg FROM e GROUP BY 1)"]
    for i in range(1, k + 1):
        steps.append(f"y{i} AS (SELECT e.dst AS id, sum({cut('(0.85 * p.pr / d.deg)', i)}) AS y FROM e JOIN p{i - 1} p ON p.id = e.src JOIN d ON d.src = e.src GROUP BY 1)")
        steps.append(f"p{i} AS (SELECT v.id, coalesce(y, 0) + (1 - (SELECT sum(y) FROM y{i})) / (SELECT count(*) FROM v) AS pr FROM v LEFT JOIN y{i} y ON y.id = v.id)")
    return "WITH " + ", ".join(steps) + f" {tail.format(k=k)}"


_query("pagerank_k3", "purchase", _pr_sql(3, "SELECT id, round(pr, 9) AS pr FROM p{k}"))(lambda g: tr.pagerank(g, 3, -1).select("id", F.round("pr", 9).alias("pr")))
_query("pagerank_top", "purchase", _pr_sql(5, "SELECT id, round(pr, 9) AS pr FROM p{k} ORDER BY round(pr, 9) DESC, id LIMIT 20"))(lambda g: tr.pagerank(g, 5, -1).select("id", F.round("pr", 9).alias("pr")).orderBy(F.col("pr").desc(), "id").limit(20))
_query("pagerank_converged", "purchase", "WITH d AS (SELECT src, count(*) AS deg FROM e GROUP BY 1), n AS (SELECT count(*) AS n FROM v), r(i, id, pr) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v, n UNION ALL SELECT i + 1, id, y + (1 - sum(y) OVER ()) / n FROM (SELECT r.i, v.id, 0.85 * coalesce(sum(p.pr / d.deg), 0) AS y FROM v JOIN r ON r.id = v.id LEFT JOIN e ON e.dst = v.id LEFT JOIN r p ON p.id = e.src LEFT JOIN d ON d.src = e.src WHERE r.i < 60 GROUP BY 1, 2), n) SELECT id, round(pr, 8) AS pr FROM r WHERE i = 60")(lambda g: tr.pagerank(g, tolerance=1e-13).select("id", F.round("pr", 8).alias("pr")))


def _cut(x: str, exponent: int, mantissa: int) -> str:
    """SQL of ``scalar.truncated`` for positive numbers."""
    e, bias = f"floor(log2({x}))", (1 << exponent - 1) - 1
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} WHEN {e} < {-bias} THEN 0.0 ELSE floor({x} / pow(2.0, {e} - {mantissa})) * pow(2.0, {e} - {mantissa}) END"


_query("pagerank_quantised", "purchase", _pr_sql(5, "SELECT id, round(pr, 9) AS pr FROM p{k}", lambda x, i: _cut(x, 6, 10)))(lambda g: tr.pagerank(g, 5, -1, quantise=lambda c: scalar.truncated(c, 6, 10)).select("id", F.round("pr", 9).alias("pr")))
_query("pagerank_staged", "purchase", _pr_sql(5, "SELECT id, round(pr, 9) AS pr FROM p{k}", lambda x, i: _cut(x, 6, 10) if i <= 2 else _cut(x, 8, 23)))(lambda g: tr.pagerank(g, 5, -1, quantise=[(0, lambda c: scalar.truncated(c, 6, 10)), (2, lambda c: scalar.truncated(c, 8, 23))]).select("id", F.round("pr", 9).alias("pr")))
_APR = """WITH d AS (SELECT v.id, coalesce(k, 0) AS deg FROM v LEFT JOIN (SELECT src, count(*) AS k FROM e GROUP BY 1) x ON x.src = v.id),
n AS (SELECT count(*)::DOUBLE AS n FROM v), m AS (SELECT count(*) AS m FROM e),
z0 AS (SELECT e.dst AS id, sum((1 / n) / deg) AS z FROM e JOIN d ON d.id = e.src, n GROUP BY 1),
s0 AS (SELECT d.id, deg, 0.85 * coalesce(z, 0) + 0.15 / n AS x, 0.85 * coalesce(z, 0) + 0.15 / n - 1 / n AS delta FROM d LEFT JOIN z0 ON z0.id = d.id, n),
a0 AS (SELECT *, abs(delta) > 0.01 * x AS act FROM s0),
z1 AS (SELECT e.dst AS id, sum(delta / deg) AS z FROM e JOIN a0 ON a0.id = e.src WHERE act OR (SELECT sum(CASE WHEN act THEN 1 + deg ELSE 0 END) FROM a0) > 0.6 * (SELECT m FROM m) GROUP BY 1),
s1 AS (SELECT a0.id, deg, x, 0.85 * coalesce(z, 0) AS delta, abs(0.85 * coalesce(z, 0)) > 0.01 * x AS act FROM a0 LEFT JOIN z1 ON z1.id = a0.id),
a1 AS (SELECT id, deg, CASE WHEN act THEN x + delta ELSE x END AS x, delta, act FROM s1),
z2 AS (SELECT e.dst AS id, sum(delta / deg) AS z FROM e JOIN a1 ON a1.id = e.src WHERE act OR (SELECT sum(CASE WHEN act THEN 1 + deg ELSE 0 END) FROM a1) > 0.6 * (SELECT m FROM m) GROUP BY 1),
s2 AS (SELECT a1.id, x, 0.85 * coalesce(z, 0) AS delta, abs(0.85 * coalesce(z, 0)) > 0.01 * x AS act FROM a1 LEFT JOIN z2 ON z2.id = a1.id),
a2 AS (SELECT id, CASE WHEN act THEN x + delta ELSE x END AS x FROM s2)
SELECT id, round(x / (SELECT sum(abs(x)) FROM a2), 9) AS x FROM a2"""
_query("apr_k3", "purchase", _APR)(lambda g: tr.accelerated_pagerank(g, 3, -1).select("id", F.round("x", 9).alias("x")))
_query("apr_reduced", "purchase", _APR.replace("sum((1 / n) / deg)", f"sum({_cut('((1 / n) / deg)', 8, 23)})").replace("sum(delta / deg)", f"sum(sign(delta) * ({_cut('abs(delta / deg)', 8, 23)}))"))(lambda g: tr.accelerated_pagerank(g, 3, -1, quantise=lambda c: scalar.truncated(c, 8, 23)).select("id", F.round("x", 9).alias("x")))
_BC = f"""WITH up(i, id, level, paths) AS (
  SELECT 0, id, CASE WHEN id = {_START} THEN 0 END, CASE WHEN id = {_START} THEN 1.0::DOUBLE END FROM v
  UNION ALL SELECT r.i + 1, r.id, coalesce(any_value(r.level), CASE WHEN count(p.paths) > 0 THEN r.i + 1 END), coalesce(any_value(r.paths), sum(p.paths))
  FROM up r LEFT JOIN e ON e.dst = r.id LEFT JOIN up p ON p.id = e.src AND p.level = r.i WHERE r.i < 16 GROUP BY r.i, r.id),
l AS MATERIALIZED (SELECT id, level, paths FROM up WHERE i = 16),
down(i, id, dependency) AS (
  SELECT 16, id, 0.0::DOUBLE FROM l
  UNION ALL SELECT r.i - 1, r.id, CASE WHEN a.level = r.i - 1 THEN a.paths * coalesce(sum((1 + w.dependency) / b.paths), 0) ELSE r.dependency END
  FROM down r JOIN l a ON a.id = r.id LEFT JOIN e ON e.src = r.id LEFT JOIN l b ON b.id = e.dst AND b.level = a.level + 1 LEFT JOIN down w ON w.id = b.id WHERE r.i > 0 GROUP BY r.i, r.id, a.level, a.paths, r.dependency)
SELECT l.id, paths, CASE WHEN level IS NOT NULL THEN round(dependency, 6) END AS dependency FROM l JOIN down ON down.id = l.id AND down.i = 0"""
_query("betweenness_source", "copurchase2", _BC)(lambda g: tr.betweenness(g, _first(g)).select("id", "paths", F.round("dependency", 6).alias("dependency")))


def _bp_sql(rounds: int) -> str:
    steps = ["b0 AS (SELECT id, CASE WHEN id % 2 = 0 THEN 0.6 ELSE 0.4 END::DOUBLE AS p, CASE WHEN id % 2 = 0 THEN 0.6 ELSE 0.4 END::DOUBLE AS b FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"m{i} AS (SELECT e.dst AS id, sum(ln(0.9 * b + 0.1 * (1 - b))) AS s0, sum(ln(0.1 * b + 0.9 * (1 - b))) AS s1 FROM e JOIN b{i - 1} ON b{i - 1}.id = e.src GROUP BY 1)")
        steps.append(f"b{i} AS (SELECT x.id, p, 1 / (1 + exp(ln(1 - p) + coalesce(s1, 0) - ln(p) - coalesce(s0, 0))) AS b FROM b{i - 1} x LEFT JOIN m{i} m ON m.id = x.id)")
    return f"WITH {', '.join(steps)} SELECT id, round(b, 6) AS b0 FROM b{rounds}"


_query("belief_propagation", "copurchase2", _bp_sql(3))(lambda g: tr.belief_propagation(g, g.vertices.select("id", F.when(F.col("id") % 2 == 0, 0.6).otherwise(0.4).alias("p0"), F.when(F.col("id") % 2 == 0, 0.4).otherwise(0.6).alias("p1")), rounds=3).select("id", F.round("b0", 6).alias("b0")))
_FM = """WITH h0 AS (SELECT id, (id * 2654435761 + 40503) % 4294967296 AS h FROM v), h1 AS (SELECT id, (h + (h >> 15) * 73244475) % 4294967296 AS h FROM h0),
r(i, id, mask, changed) AS (
  SELECT 0, id, CASE WHEN h = 0 THEN CAST(2147483648 AS BIGINT) ELSE CAST(h & -h AS BIGINT) END, true FROM h1
  UNION ALL SELECT r.i + 1, r.id, r.mask | coalesce(bit_or(p.mask), 0), (r.mask | coalesce(bit_or(p.mask), 0)) <> r.mask
  FROM r LEFT JOIN e ON e.dst = r.id LEFT JOIN r p ON p.id = e.src WHERE r.i < 24 GROUP BY r.i, r.id, r.mask),
s AS (SELECT i AS iteration, count(*) FILTER (changed) AS n_changed, sum(pow(2.0, bit_count(xor(mask, mask + 1)) - 1) / 0.77351) AS size FROM r GROUP BY 1)
SELECT CAST(iteration AS BIGINT) AS iteration, n_changed, round(size, 3) AS neighbourhood FROM s WHERE iteration <= (SELECT min(iteration) FROM s WHERE n_changed = 0)"""
_query("fm_radius", "copurchase2", _FM)(lambda g: tr.radius(g).select("iteration", "n_changed", F.round("neighbourhood", 3).alias("neighbourhood")))

# -- structure -----------------------------------------------------------------------------------------------------------------
_CC = "WITH r(id, comp) AS (SELECT id, id FROM v UNION SELECT e.dst, r.comp FROM r JOIN e ON e.src = r.id WHERE r.comp < e.dst), c AS (SELECT id, min(comp) AS comp FROM r GROUP BY 1)"
_query("cc", "copurchase2", f"{_CC} SELECT id, comp FROM c")(lambda g: sg.components(g))
_query("cc_sizes", "copurchase2", f"{_CC} SELECT comp, count(*) AS size FROM c GROUP BY 1")(lambda g: sg.components(g).groupBy("comp").agg(F.count("*").alias("size")))
_CORE = "WITH r(i, id, c) AS (SELECT 0, src, count(*) FROM e GROUP BY src UNION ALL SELECT i + 1, id, count(*) FILTER (nc >= rn) FROM (SELECT r.i, e.src AS id, n.c AS nc, row_number() OVER (PARTITION BY e.src ORDER BY n.c DESC) AS rn FROM e JOIN r ON r.id = e.src JOIN r n ON n.id = e.dst WHERE r.i < 30) GROUP BY 1, 2), core AS (SELECT id, CAST(c AS BIGINT) AS coreness FROM r WHERE i = 30)"
_query("kcore", "copurchase2", f"{_CORE} SELECT id, coreness FROM core")(lambda g: sg.coreness(g))
_query("degeneracy_order", "copurchase2", f"{_CORE}, d AS (SELECT src, count(*) AS deg FROM e GROUP BY 1) SELECT id, row_number() OVER (ORDER BY coreness, deg, id) - 1 AS rank FROM core JOIN d ON d.src = id")(lambda g: sg.degeneracy_order(g))
for _by, _keys in sg.ORDERS.items():
    if _by != "core_degree":
        _order = ", ".join(f"{'deg' if k == 'deg' else 'coreness'}{' DESC' if down else ''}" for k, down in _keys)
        _query(f"order_{_by}", "copurchase2", f"{_CORE}, d AS (SELECT src, count(*) AS deg FROM e GROUP BY 1) SELECT id, row_number() OVER (ORDER BY {_order}, id) - 1 AS rank FROM core JOIN d ON d.src = id")(lambda g, by=_by: sg.degeneracy_order(g, by=by))
_MIS = "WITH r(i, id, st) AS (SELECT 0, id, 0 FROM v UNION ALL SELECT r.i + 1, r.id, CASE WHEN r.st <> 0 THEN r.st WHEN bool_or(n.st = 1) THEN 2 WHEN bool_or(n.st = 0 AND n.id < r.id) THEN 0 ELSE 1 END FROM r JOIN e ON e.src = r.id JOIN r n ON n.id = e.dst WHERE r.i < 80 GROUP BY r.i, r.id, r.st)"
_query("mis", "copurchase2", f"{_MIS} SELECT id FROM r WHERE i = 80 AND st = 1")(lambda g: sg.independent_set(g))
_PARENTS = "d AS MATERIALIZED (SELECT src AS id, count(*) AS deg FROM e GROUP BY 1), p AS MATERIALIZED (SELECT e.src AS id, e.dst AS parent FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst WHERE b.deg > a.deg OR (b.deg = a.deg AND e.dst < e.src))"
_query("coloring_jp", "copurchase2", f"WITH {_PARENTS}, r(i, id, color) AS (SELECT 0, id, CAST(NULL AS BIGINT) FROM v UNION ALL SELECT r.i + 1, r.id, CASE WHEN r.color IS NOT NULL THEN r.color WHEN bool_or(p.parent IS NOT NULL AND n.color IS NULL) THEN NULL ELSE (list_filter(generate_series(0, count(p.parent)), lambda k: NOT list_contains(coalesce(list(n.color) FILTER (n.color IS NOT NULL), []), k)))[1] END FROM r LEFT JOIN p ON p.id = r.id LEFT JOIN r n ON n.id = p.parent WHERE r.i < 60 GROUP BY r.i, r.id, r.color) SELECT id, color FROM r WHERE i = 60")(lambda g: sg.colouring(g))
_query("dag_depth", "copurchase2", f"WITH {_PARENTS}, r(i, id, depth) AS (SELECT 0, id, CAST(0 AS BIGINT) FROM v UNION ALL SELECT r.i + 1, r.id, coalesce(max(n.depth) + 1, 0) FROM r LEFT JOIN p ON p.id = r.id LEFT JOIN r n ON n.id = p.parent WHERE r.i < 60 GROUP BY r.i, r.id) SELECT id, depth FROM r WHERE i = 60")(lambda g: sg.dag_depth(g))
_N = "(SELECT count(*) FROM v) AS n"
_Z = "CAST(0 AS BIGINT) AS "
_query("cc_validate", "copurchase2", f"SELECT {_N}, {_Z}n_crossing")(lambda g: sg.check_components(g, sg.components(g)))
_query("kcore_validate", "copurchase2", f"SELECT {_N}, {_Z}n_over_degree, {_Z}n_zero, {_Z}n_too_few, {_Z}n_too_many")(lambda g: sg.check_coreness(g, sg.coreness(g)))
_query("mis_validate", "copurchase2", f"{_MIS} SELECT (SELECT count(*) FROM r WHERE i = 80 AND st = 1) AS n, {_Z}n_adjacent, {_Z}n_addable")(lambda g: sg.check_independent_set(g, sg.independent_set(g)))
_query("coloring_validate", "copurchase2", f"SELECT {_N}, {_Z}n_uncoloured, {_Z}n_clashing")(lambda g: sg.check_colouring(g, sg.colouring(g)))
_query("coloring_speculative_validate", "copurchase2", f"SELECT {_N}, {_Z}n_uncoloured, {_Z}n_clashing")(lambda g: sg.check_colouring(g, sg.speculative_colouring(g)))
_query("bfs_validate", "copurchase", f"SELECT {_N}, {_Z}n_skipping, {_Z}n_bad_parent")(lambda g: sg.check_bfs(g, tr.bfs(g)))
_query("degree_two_chains", "copurchase2", "WITH two AS (SELECT src AS id FROM e GROUP BY 1 HAVING count(*) = 2), f AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM two) AND dst IN (SELECT id FROM two)), r(id, chain) AS (SELECT id, id FROM two UNION SELECT f.dst, r.chain FROM r JOIN f ON f.src = r.id WHERE r.chain < f.dst) SELECT id, min(chain) AS chain FROM r GROUP BY 1")(lambda g: sg.degree_two_chains(g))
_query("stars", "copurchase2", "WITH one AS (SELECT src AS leaf FROM e GROUP BY 1 HAVING count(*) = 1), r AS (SELECT dst AS centre, src AS leaf FROM e WHERE src IN (SELECT leaf FROM one)) SELECT centre, leaf FROM r WHERE centre < leaf OR centre NOT IN (SELECT leaf FROM one)")(lambda g: sg.stars(g))
_query("edge_cover", "copurchase2", "WITH m AS (SELECT src, min(dst) AS dst FROM e GROUP BY 1) SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM m")(lambda g: sg.edge_cover(g))
_TWO = "WITH two AS (SELECT src AS id FROM e GROUP BY 1 HAVING count(*) <= 2), f AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM two) AND dst IN (SELECT id FROM two)), r(id, comp) AS (SELECT id, id FROM two UNION SELECT f.dst, r.comp FROM r JOIN f ON f.src = r.id WHERE r.comp < f.dst), c AS (SELECT id, min(comp) AS comp FROM r GROUP BY 1), k AS (SELECT comp, count(DISTINCT c.id) AS n, count(f.src) // 2 AS m FROM c LEFT JOIN f ON f.src = c.id GROUP BY 1)"
_query("vertex_cover_sizes", "copurchase2", f"{_TWO} SELECT comp, CASE WHEN m = n THEN (n + 1) // 2 ELSE n // 2 END AS size FROM k WHERE m > 0")(lambda g: cliques.vertex_cover(g.induced(g.degrees().where("out_deg <= 2").select("id"))).groupBy("comp").agg(F.count("*").alias("size")))
_query("heuristic_clique_check", "copurchase2", "SELECT true AS is_clique, true AS within_maximum")(lambda g: _heuristic(g))


def _heuristic(g: Graph) -> DataFrame:
    """Whether the heuristic clique is one, and not over the maximum."""
    found = cliques.heuristic_clique(g)
    pairs = found.select("size", F.explode("members").alias("src"), "members").select("size", "src", F.explode("members").alias("dst")).where("src <> dst")
    edges = g.has_edges(pairs.select("src", "dst")).agg(F.count("*").alias("m"))
    top = cliques.maximum_clique(g).select(F.col("size").alias("top"))
    return found.crossJoin(edges).crossJoin(top).select((F.col("m") == F.col("size") * (F.col("size") - 1)).alias("is_clique"), (F.col("size") <= F.col("top")).alias("within_maximum"))


_query("edge_clique_partition_check", "copurchase2", "SELECT (SELECT count(*) FROM e WHERE src < dst) AS m, CAST(0 AS BIGINT) AS n_small, CAST(0 AS BIGINT) AS n_incomplete")(lambda g: _partition(g))


def _partition(g: Graph) -> DataFrame:
    """All edges are dealt once; cliques have four vertices or more and all their edges."""
    rows = written(cliques.edge_clique_partition(g))
    ends = rows.where("first_src is not null").select("first_src", "first_dst", F.explode(F.array("src", "dst")).alias("id")).groupBy("first_src", "first_dst").agg(F.count_distinct("id").alias("n"), (F.count("*") / 2).alias("m"))
    bad = ends.agg(F.count(F.when(F.col("n") < 4, 1)).alias("n_small"), F.count(F.when(F.col("m") != F.col("n") * (F.col("n") - 1) / 2, 1)).alias("n_incomplete"))
    return rows.select("src", "dst").distinct().agg(F.count("*").alias("m")).crossJoin(bad)


_TRI = "WITH t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND a.dst < b.dst)"
_query("triangles", "copurchase2", f"{_TRI} SELECT count(*) AS n FROM t")(lambda g: cliques.triangles(g))
_HIST = "WITH adj AS MATERIALIZED (SELECT src AS id, list(dst) AS ns FROM e GROUP BY 1), r(last, size, common) AS (SELECT dst, CAST(2 AS BIGINT), list_intersect(a.ns, b.ns) FROM e JOIN adj a ON a.id = src JOIN adj b ON b.id = dst WHERE src < dst UNION ALL SELECT x, size + 1, list_intersect(common, a.ns) FROM (SELECT last, size, common, unnest(common) AS x FROM r) JOIN adj a ON a.id = x WHERE x > last), s AS (SELECT size, count(*) AS n FROM r WHERE len(common) = 0 GROUP BY 1)"
_query("mce_histogram", "copurchase2", f"{_HIST} SELECT size, n FROM s WHERE n > 0")(lambda g: cliques.clique_histogram(g))
_query("max_clique_size", "copurchase2", f"{_HIST} SELECT max(size) AS size FROM s WHERE n > 0")(lambda g: cliques.maximum_clique(g).select("size"))

# -- statistics ------------------------------------------------------------------------------------------------------------------
_query("degree_stats", "purchase", "WITH d AS (SELECT src, count(*) AS k FROM e GROUP BY 1) SELECT count(k) AS n, min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean, round(var_samp(k), 6) AS var, round(stddev_samp(k), 6) AS sd FROM d")(lambda g: st.describe(g.edges.groupBy("src").agg(F.count("*").alias("k")), "k").withColumns({c: F.round(c, 6) for c in ("mean", "var", "sd")}))


@_query("degree_regression", sql="SELECT round(covar_samp(l_extendedprice, l_quantity), 6) AS cov, round(pow(corr(l_extendedprice, l_quantity), 2), 9) AS r2, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def _regression(spark, sf_dir):
    r = st.relation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return r.select(F.round("cov", 6).alias("cov"), F.round("r2", 9).alias("r2"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _boot_sql(side: str, seed: int) -> str:
    h = f"((o_orderkey % 1000003 * 7919 + ({seed} * 1000 + i) * 104729 + 12345) % 2147483647)"
    for _ in range(2):
        h = f"({h} * 48271 % 2147483647)"
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        steps.append(f"CASE WHEN {h} / 2147483647.0::DOUBLE > {total!r}::DOUBLE THEN 1 ELSE 0 END")
        p /= k + 1
    return f"(SELECT i, sum(o_totalprice * w) / sum(w) AS m FROM (SELECT i, o_totalprice, {' + '.join(steps)} AS w FROM orders, range(50) x(i) WHERE {side}) GROUP BY 1)"


_BOOT = "round(avg(m), 2) AS mean, round(quantile_cont(m, 0.025), 2) AS low, round(quantile_cont(m, 0.975), 2) AS high"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 2).alias(c) for c in df.columns))


@_query("bootstrap_mean", sql=f"SELECT {_BOOT} FROM {_boot_sql('true', 0)}")
def _bootstrap(spark, sf_dir):
    return _rounded(st.bootstrap_mean(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 50))


@_query("bootstrap_difference", sql=f"SELECT {_BOOT} FROM (SELECT a.m - b.m AS m FROM {_boot_sql('o_custkey % 2 = 0', 0)} a JOIN {_boot_sql('o_custkey % 2 = 1', 1)} b USING (i))")
def _bootstrap_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return _rounded(st.bootstrap_difference(o.where("o_custkey % 2 = 0"), o.where("o_custkey % 2 = 1"), "o_totalprice", "o_orderkey", 50))


@_query("normalised", sql="SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 9) AS z FROM orders")
def _normalised(spark, sf_dir):
    return st.normalised(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("z", 9).alias("z"))


@_query("split_at", sql="SELECT count(*) FILTER (x < 5) AS n_lt, round(avg(x) FILTER (x < 5), 6) AS mean_lt, round(var_samp(x) FILTER (x < 5), 6) AS var_lt, count(*) FILTER (x >= 5) AS n_ge, round(avg(x) FILTER (x >= 5), 6) AS mean_ge, round(var_samp(x) FILTER (x >= 5), 6) AS var_ge FROM (SELECT l_quantity AS x FROM lineitem)")
def _split(spark, sf_dir):
    rows = st.split_at(table(spark, sf_dir, "lineitem"), "l_quantity", F.lit(5))
    return rows.select(*(F.round(c, 6).alias(c) if c[0] != "n" else F.col(c) for c in rows.columns))


_query("degree_pdf", "purchase", "WITH d AS (SELECT count(*) AS k FROM e GROUP BY src), s AS (SELECT avg(k) AS m, stddev_samp(k) AS sd FROM d) SELECT k, round(exp(-pow((k - m) / sd, 2) / 2) / (sd * sqrt(2 * pi())), 9) AS pdf FROM (SELECT DISTINCT k FROM d), s")(lambda g: _pdf(g))


def _pdf(g: Graph) -> DataFrame:
    d = g.edges.groupBy("src").agg(F.count("*").alias("k"))
    s = d.agg(F.avg("k").alias("m"), F.stddev_samp("k").alias("sd"))
    return d.select("k").distinct().crossJoin(s).select("k", F.round(st.normal_density(F.col("k"), F.col("m"), F.col("sd")), 9).alias("pdf"))


# -- files: a graph is written in a format and read again ----------------------------------------------------------------------------
_RENUMBERED = _SQL["graph_clean_edges"]


_FEATURES, _TREE = ["l_tax", "l_discount", "l_quantity"], {"rounds": 1, "depth": 1, "bins": 16}


def _split_sql(label: str, gain: str, settled: str, out: str) -> str:
    """The leaves of a tree of one split: every cut of every feature, the best one if the rows settle it."""
    each = " UNION ALL ".join(f"SELECT {i} AS f, CAST({f} AS DOUBLE) AS x, y FROM d" for i, f in enumerate(_FEATURES))
    at = " ".join(f"WHEN {i} THEN {f} < edge" for i, f in enumerate(_FEATURES))
    return f"""
WITH d AS (SELECT *, {label} AS y FROM lineitem), rows AS ({each}), lim AS (SELECT f, min(x) AS lo, max(x) AS hi FROM rows GROUP BY f),
b AS (SELECT f, y, least(15, CAST(floor((x - lo) / (hi - lo) * 16) AS INTEGER)) AS bin FROM rows JOIN lim USING (f)),
s AS ({gain}),
g AS (SELECT f, max(gain) AS gain, arg_min(c, (-gain, c)) AS c, any_value(n) AS n FROM s WHERE gain > 0 GROUP BY f),
r AS (SELECT *, coalesce(lead(gain) OVER (ORDER BY gain DESC, f), 0) AS second, row_number() OVER (ORDER BY gain DESC, f) AS k FROM g),
best AS (SELECT f, lo + c * (hi - lo) / 16 AS edge FROM r JOIN lim USING (f) WHERE k = 1 AND ({settled}) OR k = 1 AND sqrt(ln(1e6) / (2 * n)) < 0.05),
routed AS (SELECT d.*, CAST(CASE WHEN edge IS NULL THEN 1 WHEN CASE f {at} END THEN 2 ELSE 3 END AS BIGINT) AS node FROM d LEFT JOIN best ON true)
{out}"""


_BIG = "CASE WHEN l_extendedprice >= 30000 THEN 'high' ELSE 'low' END"
_GINI = """SELECT f, c, sum(l + r) AS n,
    ((sum(l + r) - sum((l + r) * (l + r)) / sum(l + r)) - (sum(l) - sum(l * l) / sum(l)) - (sum(r) - sum(r * r) / sum(r))) / sum(l + r) AS gain
  FROM (SELECT f, c, y, CAST(count(*) FILTER (bin < c) AS DOUBLE) AS l, CAST(count(*) FILTER (bin >= c) AS DOUBLE) AS r FROM b, range(1, 16) t(c) GROUP BY 1, 2, 3)
  GROUP BY 1, 2 HAVING sum(l) > 0 AND sum(r) > 0"""
_VARIANCE = """SELECT f, c, count(*) AS n, (var_pop(y) * count(*) - var_pop(y) FILTER (bin < c) * count(*) FILTER (bin < c) - var_pop(y) FILTER (bin >= c) * count(*) FILTER (bin >= c)) / count(*) AS gain
  FROM b, range(1, 16) t(c) GROUP BY 1, 2 HAVING count(*) FILTER (bin < c) > 0 AND count(*) FILTER (bin >= c) > 0"""
_BOUND = "sqrt(ln(1e6) / (2 * n))"


@_query("hoeffding_classes", sql=_split_sql(_BIG, _GINI, f"gain - second > {_BOUND}", "SELECT node, y AS label, count(*) AS n FROM routed GROUP BY 1, 2"))
def _hoeffding_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.when(F.col("l_extendedprice") >= 30000, "high").otherwise("low"))
    return ho.leaves(rows, ho.grow(rows, _FEATURES, "y", **_TREE), "y")


@_query("hoeffding_values", sql=_split_sql("l_extendedprice", _VARIANCE, f"second / gain < 1 - {_BOUND}", "SELECT node, count(y) AS n, round(avg(y), 4) AS mean FROM routed GROUP BY 1"))
def _hoeffding_values(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    found = ho.means(rows, ho.grow(rows, _FEATURES, "l_extendedprice", classes=False, **_TREE), "l_extendedprice")
    return found.select("node", "n", F.round("mean", 4).alias("mean"))


@_query("hoeffding_lines", sql=_split_sql("l_extendedprice", _VARIANCE, f"second / gain < 1 - {_BOUND}", "SELECT node, CAST(regr_count(y, l_quantity) AS BIGINT) AS n, round(regr_slope(y, l_quantity), 4) AS slope, round(regr_intercept(y, l_quantity), 2) AS intercept FROM routed GROUP BY 1"))
def _hoeffding_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    found = ho.lines(rows, ho.grow(rows, _FEATURES, "l_extendedprice", classes=False, **_TREE), "l_quantity", "l_extendedprice")
    return found.select("node", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


def _there_and_back(name: str, write: Callable, read: Callable, weighted: bool = False) -> None:
    sql = _RENUMBERED.replace("SELECT a.k AS src, b.k AS dst FROM e", "SELECT a.k AS src, b.k AS dst, CAST(64 + ((a.k + b.k) & 127) AS DOUBLE) AS weight FROM e") if weighted else _RENUMBERED

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir, "transition").cleaned()[0].saved()
        g = g.with_weights() if weighted else g
        path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
        write(g, path)
        return read(spark, path).edges

    _Q[f"source_{name}"], _SQL[f"source_{name}"] = run, sql


_there_and_back("binary_v2", fm.write_binary, fm.load_graph)
_there_and_back("binary_v3", lambda g, p: fm.write_binary(g, p, 3), fm.load_graph)
_there_and_back("binary_weights", lambda g, p: fm.write_binary(g, p, 2, p + ".w"), lambda s, p: fm.read_binary(s, p, weights=p + ".w"), True)
_there_and_back("v4", fm.write_config, fm.load_graph)
_there_and_back("v4_weights", fm.write_config, fm.load_graph, True)
_there_and_back("adjacency", fm.write_adjacency, fm.load_graph)
_there_and_back("adjacency_weights", fm.write_adjacency, fm.load_graph, True)
_there_and_back("edge_list", fm.write_edge_list, fm.read_edge_list)
_there_and_back("edge_list_weights", fm.write_edge_list, fm.read_edge_list, True)
_there_and_back("matrix_market", fm.write_matrix_market, fm.load_graph)
_there_and_back("grazelle", fm.write_grazelle, fm.read_grazelle)
_there_and_back("v4_to_binary", lambda g, p: (fm.write_config(g, p + ".a"), fm.write_binary(fm.load_graph(g.edges.sparkSession, p + ".a"), p)), fm.load_graph)
_there_and_back("binary_to_text", lambda g, p: (fm.write_binary(g, p + ".a"), fm.write_adjacency(fm.load_graph(g.edges.sparkSession, p + ".a"), p)), fm.load_graph)


@_query("source_property", sql="SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, o_totalprice AS value FROM orders")
def _property(spark, sf_dir):
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-property"
    rows = ranked(table(spark, sf_dir, "orders"), [F.col("o_orderkey")], "id").select("id", F.col("o_totalprice").alias("value"))
    fm.write_property(rows, path)
    return fm.read_property(spark, path)


def _run(f: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: partial(_run, f) for k, f in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
