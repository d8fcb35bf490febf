"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridge.runtime import ranked, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BINS = 1024


def words(text: Column) -> Column:
    """The number of runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` for ``sizes(source, source_size)``, one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes. What exceeds ``most`` times a source's size is shared out anew by weight among the others until none is above: a search for the level L with targets min(most * size, L * weight).
    """
    turn = F.array(*map(F.lit, weights))
    own = written(ranked(sizes, [F.col("source").asc_nulls_last()], "rank").select("source", "source_size", F.get(turn, (F.col("rank") % len(weights)).cast("int")).alias("w")))
    total = share * (own.agg(F.sum("source_size")).first()[0] or 0)
    level, cap = None, F.col("source_size") * most
    while True:
        full = F.lit(False) if level is None else cap < F.col("w") * level
        held, open_w = own.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        now = (total - (held or 0)) / open_w if open_w else float("inf")
        if now == level or not open_w:
            level = now
            break
        level = now
    return own.select("source", "source_size", F.least(cap, F.col("w") * level).alias("target"))


def _rate(most: float) -> Column:
    """The tilted rate of a document; a source whose target is all that it may give gets that rate without a tilt."""
    return F.when(F.col("target") >= most * F.col("source_size"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))


def tilts(cells: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = 1e-9, max_rounds: int = 40) -> DataFrame:
    """``(source, source_size, target, mean, tilt)``: the dual variable of each source's token constraint.

    Rates that stay nearest to one in relative entropy, at most ``most``, and meet the constraint are min(most, exp(tilt * size / mean size)). Each round is a Newton step of every source's dual at once, from one grouped sum over ``cells(source, size, n)``; a bracket halves steps that leave it, since the cap bends the dual's slope.
    """
    mean = cells.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = written(
        targets.join(mean, targets["source"].eqNullSafe(mean["source"]))
        .select(targets["source"], "source_size", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"))
        .select("*", F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("lo"), F.lit(50.0).alias("hi"))
    )
    mass = F.col("n") * F.col("size")
    rate = _rate(most)
    for _ in range(max_rounds):
        c, s = cells.alias("c"), state.alias("s")
        joined = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.*", "n", "size")
        sums = joined.groupBy("source", "source_size", "target", "mean", "tilt", "lo", "hi").agg(
            F.sum(mass * rate).alias("got"), F.sum(F.when(rate < most, mass * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")
        )
        miss = F.col("target") - F.col("got")
        done = (F.abs(miss) <= tolerance * F.col("target")) | (F.col("target") >= most * F.col("source_size"))
        lo, hi = F.when(miss > 0, F.col("tilt")).otherwise(F.col("lo")), F.when(miss < 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") + F.try_divide(miss, F.col("slope"))
        tilt = F.when(done, F.col("tilt")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        state = written(sums.select("source", "source_size", "target", "mean", tilt.alias("tilt"), lo.alias("lo"), hi.alias("hi"), done.alias("done")))
        if not state.where("not done").take(1):
            break
    return state.drop("lo", "hi", "done")


def _measures(text: Column, id_col: Column, source: Column) -> list[Column]:
    """Id, source, size, and a hash that only rows share that are equal in these and in the text."""
    t = text.cast("string")
    own = [id_col.cast("long").alias("doc_id"), source.cast("string").alias("source"), words(t).alias("size")]
    return [*own, F.xxhash64(F.lit("mix"), id_col.cast("long"), F.lit("|"), source.cast("string"), F.lit("|"), t).alias("same")]


def _drawn(rows: DataFrame) -> DataFrame:
    """``rows`` with a repeatable ``draw`` from 0 up to 1. Rows that share ``same`` are numbered, in whatever order, so that each has a draw of its own and together they have the same in every run. One range of equal rows can span tasks."""
    many = written(rows.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"))
    if many.take(1):
        ties = ranked(rows.join(many, "same", "left_semi").withColumn("__tie", F.monotonically_increasing_id()), [F.col("same"), F.col("__tie")], "__place").drop("__tie")
        ties = written(ties)
        first = ties.groupBy("same").agg(F.min("__place").alias("__first"))
        numbered = ties.join(first, "same").withColumn("nth", F.col("__place") - F.col("__first")).select(*rows.columns, "nth")
        rows = rows.join(many, "same", "left_anti").select(*rows.columns).withColumn("nth", F.lit(0).cast("long")).union(numbered)
    else:
        rows = rows.withColumn("nth", F.lit(0).cast("long"))
    return rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64("same", "nth"), 11).cast("double") / float(1 << 53)).drop("nth")


def _spread(params: DataFrame, docs: DataFrame, most: float) -> tuple[DataFrame, Column, Column]:
    """Documents with their source's parameters, whole copies that the rate has, and the order in which others round up."""
    d, p = docs.alias("d"), params.alias("p")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", *(F.col(f"p.{c}") for c in params.columns if c != "source"))
    rate = _rate(most)
    return joined, F.floor(rate).cast("long"), F.col("draw") - (rate - F.floor(rate)) + 1


def rounding(docs: DataFrame, params: DataFrame, most: float = MOST) -> DataFrame:
    """``params`` with, for each source, which documents round up, so that the tokens meet the target to a document.

    Rates round up where the draw is under the rate's fraction, moved by what the source's sum needs, and one copy more stays within ``most``: two histograms of the draws, the second within one bin of the first, find the limit; the first document that it leaves out gives the last words as a part.
    """
    whole = _spread(params, docs, most)[1]

    def level(params: DataFrame, lo: Column, width: float) -> DataFrame:
        joined, whole, v = _spread(params, docs, most)
        bins = joined.withColumn("b", F.floor((v - lo) / width * BINS).cast("long"))
        return bins.groupBy("source", "b").agg(F.sum(F.when(whole + 1 <= most, F.col("size")).otherwise(0)).alias("tokens"), F.sum(whole * F.col("size")).alias("base"))

    def limit(params: DataFrame, hist: DataFrame, name: str, budget: Column) -> DataFrame:
        """The last bin before which all fits in the budget, and what is left of it there."""
        cells = hist.where(F.col("b").between(0, BINS - 1)) if name == "sub" else hist
        listed = cells.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("b", "tokens"))).alias("cells"), F.sum("base").alias("base"))
        p, h = params.alias("p"), listed.alias("h")
        start = F.struct(budget.cast("double").alias("left"), F.lit(-1).cast("long").alias("at"))
        walk = F.aggregate("cells", start, lambda a, c: F.when((a["at"] >= 0) | (a["left"] < c["tokens"]), F.struct(a["left"].alias("left"), F.when(a["at"] >= 0, a["at"]).otherwise(c["b"]).alias("at"))).otherwise(F.struct((a["left"] - c["tokens"]).alias("left"), a["at"].alias("at"))))
        return p.join(h, F.col("p.source").eqNullSafe(F.col("h.source")), "left").select("p.*", walk.alias("walk")).select(
            *params.columns if name == "bin" else [c for c in params.columns if c != "left"],
            F.coalesce(F.when(F.col("walk.at") >= 0, F.col("walk.at")), F.lit(2 * BINS)).alias(name),
            F.coalesce("walk.left", F.lit(0.0)).alias("left"),
        )

    hist = level(params, F.lit(0.0), 2.0)
    one = written(limit(params, hist, "bin", F.col("target") - F.col("base")))
    width = 2.0 / BINS
    hist = level(one, F.col("bin") * width, width)
    two = written(limit(one, hist, "sub", F.col("left")))
    joined, whole, v = _spread(two, docs, most)
    out = joined.where((v >= F.col("bin") * width + F.col("sub") * (width / BINS)) & (F.col("size") * (most - whole) >= F.round("left")) & (F.round("left") > 0))
    last = out.withColumn("v", _spread(two, docs, most)[2]).groupBy("source").agg(F.min(F.struct("v", "doc_id")).alias("m")).select("source", F.col("m.v").alias("part_v"), F.col("m.doc_id").alias("part_doc"))
    p, x = two.alias("p"), last.alias("x")
    return written(p.join(x, F.col("p.source").eqNullSafe(F.col("x.source")), "left").select("p.*", "part_v", "part_doc"))


def _sized(docs: DataFrame, text: str, id_col: str, source: str) -> DataFrame:
    return written(_drawn(written(docs.select(*_measures(F.col(text), F.col(id_col), F.col(source))))))


def _plan(sized: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    cells = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    return rounding(sized, tilts(cells, target_sizes(sizes, weights, share, most), most), most)


def _decided(sized: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """``sized`` with its source's size and target, whole copies, and words beyond them."""
    joined, whole, v = _spread(plan, sized, most)
    width = 2.0 / BINS
    up = (whole + 1 <= most) & (v < F.col("bin") * width + F.col("sub") * (width / BINS))
    part = F.when(~up & F.col("doc_id").eqNullSafe(F.col("part_doc")) & (v == F.col("part_v")), F.least(F.round("left").cast("long"), (F.col("size") * (most - whole)).cast("long"))).otherwise(0)
    copies = F.when(F.col("size") == 0, 0).otherwise(whole + up.cast("long"))
    return joined.withColumns({"copies": copies.cast("long"), "part": part.cast("long")})


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, part, taken)`` for every row of ``docs``: how often the mix takes it whole, how many words it takes beyond that, and all words.

    Sizes count words of whole texts; a null or empty text has none and isn't taken. Null sources are a source, the last. Rows that repeat an id, a text or both are decided one by one; rows equal in all are taken as often together in every run. An empty table gives no rows. Per source the only grouped state is a sum, a histogram of at most twice ``BINS`` draws, or one row for each distinct size. Other columns aren't read.
    """
    sized = _sized(docs, text, id_col, source)
    return _decided(sized, _plan(sized, weights, share, most), most).select("doc_id", "size", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: rows of ``docs``, with all their columns, repeated as often as they are taken; a part is the row with its first words only.

    Documents without words aren't in it. Texts aren't shuffled, but for those of rows that repeat an id and text: they meet their source's parameters, one row a source.
    """
    plan = _plan(_sized(docs, text, id_col, source), weights, share, most)
    row = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    sized = row.select("row", *_measures(*(F.col(f"row.{c}") for c in (text, id_col, source))))
    decided = _decided(_drawn(sized), plan, most)
    count = F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("part").cast("string"), F.lit("}+"))
    head = F.call_function("regexp_extract", F.col(f"row.{text}").cast("string"), count, F.lit(0))
    whole = F.array_repeat(F.lit(False), F.col("copies").cast("int"))
    each = F.explode(F.when(F.col("part") > 0, F.concat(whole, F.array(F.lit(True)))).otherwise(whole))
    return decided.withColumn("cut", each).select(*(F.when(F.col("cut"), head).otherwise(F.col(f"row.{c}")).alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns))
