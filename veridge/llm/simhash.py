"""SimHash near-duplicates: buckets of equal blocks bring fingerprints together, distance tables to reference fingerprints discard, Hamming distance verifies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise, repeat
from math import ceil, log, log1p, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridge.operators.components import connected_components
from veridge.runtime import written

MAX_BITS = 4
WORDS = 4
PIVOTS = 16
SEED = 42
_CHUNK = 1 << 16
#: Wide fingerprints: bits that are compared, how many of them may differ, references of a bucket's distance table, members of a tile.
COMPARED, WIDE_BITS, REFERENCES, TILE = 192, 60, 16, 256
#: A bit of two sets of similarity 0.8 agrees with this chance at least (sets of 4 and 5; 0.839 for the next, 0.8485 for large ones), and such a pair shares no block with this chance at most.
AGREE, MISS = 0.8125, 5e-5
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text, as a signed integer.

    A-Z become lower case; words are runs of other than ASCII white space; shingles of ``words`` words, repeats included, are hashed by XXH64. A text of fewer words is one shingle, a text without words (or null) has fingerprint zero. A bit is set if more than half the hashes have it. Bits are counted a chunk of shingles at a time, so that a very long text takes bounded memory.
    """
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = w[at : at + _CHUNK + words - 1] if len(w) >= words else w
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the hashes of their own numbers, signed."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), SEED)).astype(np.int64)) for i in range(n)]


def block_masks(max_bits: int = MAX_BITS, blocks: int | None = None, match: int | None = None) -> list[int]:
    """Masks of the bits that a key keeps: ``match`` of ``blocks`` blocks, for every choice.

    Two fingerprints that differ in at most ``max_bits`` bits leave ``blocks - max_bits`` blocks untouched, so that they agree on a mask at least.
    """
    blocks = blocks or max_bits + 2
    match = match or blocks - max_bits
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(one, match)]


def _distances(fp: str, refs: list[int]):
    """Distances to up to eight references, a byte each, in a long."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(refs):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(F.col(fp).bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
    return out


def _buckets(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(t, key, fp, head, dh)``: every fingerprint of ``fps`` in each bucket of several, with the bucket's head, one of its members, as its own reference and the distance to it."""
    keys = F.explode(F.array(*(F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(block_masks(max_bits)))))
    keyed = fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    heads = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp"), "fp")).alias("h")).where("n > 1").select("t", "key", F.col("h.fp").alias("head"))
    return keyed.join(heads, ["t", "key"]).select("t", "key", "fp", "head", F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))).cast("byte").alias("dh"))


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(src, dst)``: links between distinct fingerprints that differ in at most ``max_bits`` bits, enough for the components of all such pairs.

    ``fps`` has a distinct non-null long column fp. Fingerprints that are close share a bucket at least. First each bucket's members that are close to its head are linked to it, so that a dense group takes one link a member and bucket; then pairs of a bucket whose ends are in different components still meet. Of these, pairs are discarded by the distance table, first the bucket's own reference, then ``PIVOTS`` common ones, if a coordinate differs by more than ``max_bits``; the rest are verified. A frequent bucket is an equi-join's key, which adaptive execution can split.
    """
    refs = pivots()
    buckets = written(_buckets(fps, max_bits))
    star = written(buckets.where((F.col("dh") <= max_bits) & (F.col("fp") != F.col("head"))).select(F.least("fp", "head").alias("src"), F.greatest("fp", "head").alias("dst")).distinct())
    comps = written(connected_components(star)).toDF("fp", "comp")
    left = written(buckets.join(comps, "fp", "left").select("t", "key", "fp", "dh", F.coalesce("comp", "fp").alias("comp")))
    several = left.groupBy("t", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("t", "key")
    table = [_distances("fp", refs[i : i + 8]).alias(f"d{i // 8}") for i in range(0, len(refs), 8)]
    rest = written(left.join(several, ["t", "key"]).select("*", *table))
    a, b = rest.alias("a"), rest.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    cond = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.comp") != F.col("b.comp")) & (F.abs(F.col("a.dh") - F.col("b.dh")) <= max_bits)
    for i in range(len(refs)):
        byte = [F.shiftrightunsigned(F.col(f"{s}.d{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255)) for s in "ab"]
        cond = cond & (F.abs(byte[0] - byte[1]) <= max_bits)
    across = a.join(b, cond & (F.bit_count(differ) <= max_bits)).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    return star.union(across.distinct())


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Copies share a fingerprint and count once; distinct fingerprints are linked and followed to components, whose id is the smallest doc_id in them (null if none has one). Empty and null texts have fingerprint zero and are linked like any other. Other columns of ``docs`` aren't read.
    """
    own = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), _fingerprints(F.col(text).cast("string")).alias("fp")))
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = written(connected_components(link_fingerprints(fps.select("fp"), max_bits)).withColumnRenamed("id", "fp"))
    root = written(fps.join(comps, "fp").groupBy("comp").agg(F.min("least").alias("least_all")))
    known = written(fps.join(comps.join(root, "comp"), "fp", "left").select("fp", F.coalesce("least_all", "least").alias("component_id")))
    return own.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, the one with the smallest id; of several fingerprints with that id in it the smallest, and of rows that repeat both, one. Rows without an id stay."""
    groups = near_duplicates(docs, text, id_col, max_bits)
    keep = groups.where("doc_id = component_id").groupBy("component_id").agg(F.min("fingerprint").alias("__print")).withColumnRenamed("component_id", "__keep")
    named = docs.withColumn("__own", F.lpad(F.lower(F.hex(_fingerprints(F.col(text).cast("string")))), 16, "0"))
    own = (F.col(id_col).cast("long") == F.col("__keep")) & (F.col("__own") == F.col("__print"))
    with_id = named.join(keep, own, "left_semi").dropDuplicates([id_col, "__own"]).drop("__own")
    return with_id.unionByName(docs.where(F.col(id_col).isNull()))


def wide_blocks(n: int) -> tuple[int, int]:
    """Blocks of a wide fingerprint and the bits of each, for ``n`` texts: a bucket has up to 4,096 by chance, and as many blocks as ``MISS`` asks."""
    bits = min(20, max(8, ceil(log2(max(n, 1))) - 12))
    return max(ceil(log(MISS) / log1p(-(AGREE**bits))), ceil(COMPARED / bits)), bits


def wide_fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The SimHash of distinct shingle hashes in 64-bit words, ``bits`` bits at least. The first word's bits are those of the hashes, each further word's those of another hash of them. The empty set has zero."""
    words = -(-bits // 64)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # so many fit a byte
        x = hashes[at : at + 255, None] + _STEP * np.arange(words, dtype=np.uint64)
        for shift, factor in zip((30, 27), _MIX, strict=True):
            x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(shift))) * factor
        x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def block_keys(print_: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    """A key for each block of a wide fingerprint: its number and its bits."""
    each = np.unpackbits(print_.view(np.uint8), bitorder="little")[: blocks * bits].reshape(blocks, bits)
    return (each @ (1 << np.arange(bits)) + (np.arange(blocks) << bits)).astype(np.int32)


def _apart(a: np.ndarray, b: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Hamming distances between columns of two arrays of words; up to 255. ``room`` is used for what is between."""
    shape = (a.shape[1], b.shape[1])
    differ = np.empty(shape, np.uint64) if room is None else room[: shape[0] * shape[1]].reshape(shape)
    out = np.zeros(shape, np.uint8)
    for x, y in zip(a, b, strict=True):
        out += np.bitwise_count(np.bitwise_xor(x[:, None], y, out=differ))
    return out


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels, each a place that has itself, after the places ``x`` and ``y`` are joined."""
    while True:
        a, b = label[x], label[y]
        if not (differ := a != b).any():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def linked(prints: np.ndarray, max_bits: int = WIDE_BITS) -> np.ndarray:
    """For each column of ``prints``, words by members, the place of a member of its group; groups are those of all pairs that differ in at most ``max_bits`` bits.

    Members far from each other are references, the first and then the farthest from those before, with a table of distances to them. Members near a reference are linked to it. The others are sorted by their nearest reference and the distance to it, and cut into tiles; two tiles are not compared if some reference has them farther apart than ``max_bits``, by their least and greatest distances to it, or if one group has both. Hamming distances decide the rest.
    """
    n = prints.shape[1]
    label, table, at = np.arange(n), np.empty((n, max(1, min(REFERENCES, n // 32))), np.int16), 0
    for k in range(table.shape[1]):
        table[:, k] = _apart(prints[:, at : at + 1], prints)[0]
        near = np.flatnonzero(table[:, k] <= max_bits)
        label = _joined(label, np.full(len(near), at), near)
        at = int(table[:, : k + 1].min(1).argmax())
    cell = table.argmin(1)
    order = np.lexsort((table[np.arange(n), cell], cell))
    prints, starts = prints[:, order], np.arange(0, n, TILE)
    room = np.empty(min(n, TILE) ** 2, np.uint64)
    low, high = (f.reduceat(table[order], starts, axis=0) for f in (np.minimum, np.maximum))
    for x in range(len(starts)):
        gap = np.maximum(low[x] - high[x:], low[x:] - high[x]).max(1)
        for y in np.flatnonzero(gap <= max_bits) + x:
            a, b = slice(x * TILE, (x + 1) * TILE), slice(y * TILE, (y + 1) * TILE)
            both = label[order[a]], label[order[b]]
            if all((v == both[0][0]).all() for v in both):
                continue
            apart = _apart(prints[:, a], prints[:, b], room)
            if x != y and apart.min() > max_bits:
                continue
            i, j = divmod(np.flatnonzero(apart <= max_bits), apart.shape[1])
            label = _joined(label, order[a][i], order[b][j])
    return label


def _bucket_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The groups of a task's buckets: ``(key, node, head)`` for each member of a group of several."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    key, node, *words = (np.concatenate([b[c].to_numpy() for b in parts]) for c in parts[0].columns)
    order = np.lexsort((node, key))
    key, node, prints = key[order].astype(np.uint64), node[order], np.stack(words)[:, order].view(np.uint64)
    for lo, hi in pairwise([0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]):
        if hi - lo < 2:
            continue
        label = linked(prints[:, lo:hi])
        inside = np.flatnonzero(np.bincount(label, minlength=hi - lo)[label] > 1)
        if len(inside):
            own, group = node[lo:hi][inside], label[inside]
            salt = key[lo] * _STEP + np.uint64(1)
            first = np.lexsort((own, group))  # the smallest: buckets with much in common have few heads
            heads = own[first][np.searchsorted(group[first], group)]
            yield pd.DataFrame({"key": (node[lo:hi][group].view(np.uint64) ^ salt).view(np.int64), "node": own, "head": heads})


def wide_groups(prints: DataFrame, n: int, blocks: int) -> DataFrame:
    """``(key, node, head)``: groups of wide fingerprints that share a block, linked where the compared bits differ in at most ``WIDE_BITS``.

    ``prints`` has a row for each of about ``n`` nodes: node, the words w0, w1, ... that are compared, and the array keys, of ``blocks`` keys. A row here is a node in a group of several, which key names; head is its smallest member, so that nodes that share many buckets have few links to heads. Rows are dealt by key to tasks of about half a million, where buckets are compared without rows for pairs.
    """
    words = [c for c in prints.columns if c not in ("node", "keys")]
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * blocks // (1 << 19))
    keyed = prints.select(F.explode("keys").alias("key"), "node", *words)
    return keyed.repartition(parts, "key").mapInPandas(_bucket_groups, "key long, node long, head long")
