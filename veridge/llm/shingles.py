"""Near-duplicates by the Jaccard similarity of five-word shingles: SimHash with its distance tables proposes pairs, the exact similarity verifies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridge.llm.simhash import COMPARED, block_keys, wide_blocks, wide_fingerprint, wide_groups
from veridge.operators.components import connected_components
from veridge.runtime import written

WORDS, LEAST = 5, 0.8
SEED = 42
#: Members of a block, hubs of a group beside its first member, and members up to which a group is compared as a whole and not by its buckets.
BLOCK, HUBS, LARGE = 512, 4, 1 << 15
#: Sets and shingles that are compared at a time, and shingles that a task has.
_TILE, _COLUMNS, _TASK = 128, 1 << 13, 1 << 21


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles, sorted. Words are as for SimHash; a text of fewer is one shingle, one without words has none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    each = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(SEED)), dtype=np.uint64))


def _prints(blocks: int, bits: int):
    """A text's wide fingerprint: the words that are compared, and the keys of its blocks."""
    words = COMPARED // 64

    @F.pandas_udf(", ".join([*(f"w{i} long" for i in range(words)), "keys array<int>"]))
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            each = [wide_fingerprint(shingles(t), blocks * bits) for t in batch]
            first = np.array([p[:words] for p in each], np.uint64).reshape(-1, words).view(np.int64)
            yield pd.DataFrame({f"w{i}": first[:, i] for i in range(words)} | {"keys": [block_keys(p, blocks, bits) for p in each]})

    return prints


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles(t).view(np.int64) for t in batch])


def _node(text) -> F.Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _close(comps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], cross: bool, least: float) -> list[tuple[int, int]]:
    """Pairs of places of sets that reach the similarity, of different components and, for ``cross``, of different sides; of each row only the first that joins it to one before, for what joins them all."""
    sizes = np.array([len(x) for x in sets])
    owner, hashes = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, column, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1  # shingles of one set only make nothing common
    some = counts[column] > 1
    owner, column = owner[some], place[column[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    wide = min(_COLUMNS, int(column[-1]) + 1) if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + _COLUMNS + 1 if len(column) else 1, _COLUMNS))
    for i, j in zip(edges, edges[1:], strict=False):
        m = np.zeros((len(sets), wide), np.float32)
        m[owner[i:j], column[i:j] % _COLUMNS] = 1
        common += m @ m.T
    good = common >= least * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    good &= np.tri(len(sets), k=-1, dtype=bool) & (comps[:, None] != comps[None, :])
    if cross:
        good &= sides[:, None] != sides[None, :]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(*(v.tolist() for v in np.nonzero(good)), strict=True):
        if (p := find(x)) != (q := find(y)):
            root[p] = q
            out.append((x, y))
    return out


def _tiled(comps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], cross: bool, least: float) -> list[tuple[int, int]]:
    """As ``_close``, for any number of sets: by tiles in order of size, but not tiles whose sizes are too far apart."""
    sizes, comps, out = np.array([len(x) for x in sets]), comps.copy(), []
    order = np.argsort(sizes, kind="stable")
    tiles = [order[i : i + _TILE] for i in range(0, len(sets), _TILE)]
    for i, a in enumerate(tiles):
        for b in tiles[i:]:
            if sizes[a[-1]] < least * sizes[b[0]] - 1e-6:
                break
            both = a if a is b else np.append(a, b)
            if (comps[both] == comps[both[0]]).all() or cross and (sides[both] == sides[both[0]]).all():
                continue
            for x, y in _close(comps[both], sides[both], [sets[k] for k in both.tolist()], cross, least):
                x, y = both[x], both[y]
                comps[comps == comps[x]] = comps[y]
                out.append((int(x), int(y)))
    return out


def _compared(rows: DataFrame, elements: int, least: float) -> DataFrame:
    """``(src, dst)``: links that join what the pairs that reach the similarity join, of the rows ``(key, lo, hi, own, node, comp, set)`` that share key, lo and hi; those of different own if lo and hi differ. Sets of a task are about ``_TASK`` of all ``elements``."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        key, lo, hi, own, node, comp = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "node", "comp"))
        held = t.column("set").chunk(0)
        values, at = held.values.to_numpy(), held.offsets.to_numpy()
        order = np.lexsort((hi, lo, key))
        first = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (key, lo, hi)], axis=0)) + 1
        for i, j in pairwise([0, *first.tolist(), len(order)]):
            if j - i < 2:
                continue
            some = order[i:j]
            found = _tiled(comp[some], own[some], [values[at[k] : at[k + 1]] for k in some.tolist()], lo[some[0]] != hi[some[0]], least)
            x, y = (node[some[[p[k] for p in found]]] if found else node[:0] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([np.minimum(x, y), np.maximum(x, y)], names=["src", "dst"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), elements // _TASK)
    return rows.select("key", "lo", "hi", "own", "node", "comp", "set").repartition(parts, "key", "lo", "hi").mapInArrow(links, "src long, dst long")


def _blocks(n) -> F.Column:
    return F.ceil(n / BLOCK).cast("int")


def _place(k) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("block"), "node"), k).cast("int")


def _near(buckets: DataFrame) -> DataFrame:
    """``(node, key)``: what the links of nodes to their heads reach, by its smallest node. A node is linked to its smallest head, and its other heads to that one, which joins the same by about a link a node."""
    heads = written(buckets.where("node <> head").groupBy("node").agg(F.min("head").alias("to"), F.collect_set("head").alias("heads")))
    links = heads.select("node", "to").union(heads.select(F.explode("heads").alias("node"), "to").where("node <> to").distinct())
    return written(connected_components(links, "node", "to").toDF("node", "key"))


def _first_blocks(near: DataFrame) -> DataFrame:
    """``(node, key, n, blocks)`` for the nodes of groups ``(node, key)``, where a key is its group's smallest node: the size of the group, and the blocks of about ``BLOCK`` members that a node is in. That is one, but hubs are in all, so that what they are near is joined across blocks."""
    sized = near.join(near.groupBy("key").agg(F.count("*").alias("n")), "key")
    k = _blocks(F.col("n"))
    hub = (F.col("node") == F.col("key")) | (F.pmod(F.xxhash64(F.lit("hub"), "node"), F.col("n")) < HUBS)
    return sized.select("node", "key", "n", F.when(hub, F.sequence(F.lit(0), k - 1)).otherwise(F.array(_place(k))).alias("blocks"))


def _later_blocks(members: DataFrame) -> DataFrame:
    """``(key, own, first, last, node, comp)`` for the members ``(key, node, comp)`` of groups of several components: a member's block, and the range of blocks that it meets. The largest component has blocks of its own, which meet the others but not each other."""
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("several")).where("several > 1")
    of = members.join(open_.select("key", "n", "most.comp", "most.n").toDF("key", "n", "main", "most"), "key")
    m, k, own = _blocks(F.col("most")), _blocks(F.col("most")) + _blocks(F.col("n") - F.col("most")), F.col("comp") == F.col("main")
    return of.select("key", F.when(own, _place(m)).otherwise(m + _place(k - m)).alias("own"), F.when(own, m).otherwise(F.lit(0)).alias("first"), (k - 1).alias("last"), "node", "comp")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """``(doc_id, node, comp, keep_id, keep_node)`` for each distinct pair of id and text: the text's hash, its component, and the pair that stays of it.

    Equal texts are one node. A node's fingerprint is the SimHash of its set of shingles, wide enough for a similarity of 0.8; ``wide_groups`` brings those together that share a block and of whose compared bits few differ. What these links reach is a group. Sets are compared in tasks that have a block of a group or two: first each block with the group's hubs, where each set goes once and large components become whole; then, in groups of several blocks, every pair of blocks, so that members of different components meet. Groups beyond ``LARGE`` do this bucket by bucket. Every link is verified, so components are those of all proposed pairs at least, while pairs inside a component aren't listed. Of a component the row with the smallest id stays (of several with this id, the smallest text hash); rows without an id don't count.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null").withColumn("node", _node(F.col("text")))
    n = own.count()
    blocks, bits = wide_blocks(n)
    rows = written(own.select("doc_id", "node", _prints(blocks, bits)("text").alias("p")).select("doc_id", "node", "p.*"))
    prints = [c for c in rows.columns if c not in ("doc_id", "node")]
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in prints)))
    buckets = written(wide_groups(nodes.select("node", *prints), n, blocks))
    dealt = written(_first_blocks(_near(buckets)))
    # The texts meet by a merge at any size: a plan that changes with the table's size would change its share of disk.
    sets = written(own.select("node", "text").join(dealt.hint("merge"), "node").dropDuplicates(["node"]).select("node", "key", "n", "blocks", _shingles("text").alias("set")).withColumn("size", F.size("set")))

    every = sets.agg(F.sum(F.col("size") * F.size("blocks")), F.avg("size"), F.max("n")).first()
    lo = sets.select("key", F.explode("blocks").alias("lo"), "node", "set")
    links = written(_compared(lo.select("*", F.col("lo").alias("hi"), F.col("lo").alias("own"), F.col("node").alias("comp")), every[0] or 0, least))
    comps = _named(nodes.select("node"), links)

    if (every[2] or 0) > BLOCK:
        whole = dealt.where((F.col("n") > BLOCK) & (F.col("n") <= LARGE)).select("key", "node")
        by_bucket = buckets.select("key", "node").join(dealt.where(F.col("n") > LARGE).select("node"), "node").select("key", "node")
        later = written(_later_blocks(written(whole.union(by_bucket).join(comps, "node"))))
        copies = later.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
        # Rows for pairs of blocks are made after the join, whose side may be broadcast.
        met = later.join(sets.select("node", "set"), "node").withColumn("other", F.explode(F.sequence("first", "last")))
        more = written(_compared(met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")), int(copies * every[1]), least))
        comps = _named(nodes.select("node"), links.union(more))

    best = written(nodes.join(comps, "node").groupBy("comp").agg(F.min(F.struct("least", "node")).alias("m")).select("comp", F.col("m.least").alias("keep_id"), F.col("m.node").alias("keep_node")))
    return rows.select("doc_id", "node").distinct().join(comps, "node").join(best, "comp").select("doc_id", "node", "comp", "keep_id", "keep_node")


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    comps = connected_components(links).select(F.col("id").alias("node"), "comp")
    return written(nodes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each near-duplicate component; of rows with its id and its text, one. Rows without an id stay."""
    keep = written(near_duplicates(docs, text, id_col, least).select(F.col("keep_id").alias("__id"), F.col("keep_node").alias("__node")).distinct())
    named = docs.withColumn("__own", _node(F.col(text)))
    own = (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__own") == F.col("__node"))
    return named.join(keep, own, "left_semi").dropDuplicates([id_col, "__own"]).drop("__own").unionByName(docs.where(F.col(id_col).isNull()))
