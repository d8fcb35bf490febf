"""Removing repeated byte strings with a logarithmic family of suffix arrays.

A string of ``length`` bytes that stands at a place is a window. Each window has an anchor, its leftmost smallest hash of ``k`` bytes; equal windows have their anchors at equal offsets, and consecutive windows with one anchor are a run. A run is kept as the suffix that starts at its anchor and the reversed prefix that ends there. Both are sorted, with the common lengths of neighbours: suffixes that agree on r bytes lie together, prefixes that agree on l bytes too, so two windows that reach l bytes to the left are equal if and only if both their classes are. Every equality is one of bytes; hashes only choose anchors and deal work.

New entries come to an index in batches. A batch gets its own arrays, which settle repeats inside it; it is then merge-scanned against each level that the index has, and becomes a level itself; levels of like size merge, so that there are logarithmically many.

Two things keep the volume near that of the repeats. A batch of a map task settles its own texts and sends on, in a first pass, only anchors (a hash and a place) of what is left; a window can only repeat elsewhere if its anchor comes in two batches. The second pass opens those windows and sends their bytes, once a batch, to the shard of their anchor. Anchors so frequent that one shard would be loaded step back in the second pass: windows take another anchor if they have one, which their context gives, and windows of frequent grams alone are few. Shards are counted by bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridge.runtime import ranked, written

LENGTH = 100
K = 32
#: Positions that are hashed at a time, bytes of a map task's batch, entries of a shard's batch.
SEGMENT, BATCH, ENTRIES = 1 << 19, 1 << 23, 1 << 16
#: Of an anchor with more places than this in a batch one is sent; the batch opens them all.
FEW = 8
#: Bytes of entries that a shard may hold, and places of an anchor from which on it may count as frequent.
SHARD, FREQUENT = 1 << 26, 1 << 12
_POS = np.uint64((1 << 24) - 1)
ROWS = "shard int, kind int, n long, blob binary"
ENTRY, REPEAT, OPEN, HOT = range(4)
RANGE = np.dtype([("uid", "<i8"), ("lo", "<i8"), ("hi", "<i8")])


class Anchors:
    """Finds the runs of byte strings. ``hot`` are grams that step back."""

    def __init__(self, length: int = LENGTH, k: int = K, hot: np.ndarray | None = None) -> None:
        if k & (k - 1) or k > length:
            raise ValueError("k is a power of two of at most length")
        self.length, self.k, self.w = length, k, length - k + 1
        self.hot = np.zeros(0, np.uint64) if hot is None else np.sort(hot)
        rng = np.random.default_rng(7)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.mul = rng.integers(1, 1 << 63, (16, 2), dtype=np.uint64) | np.uint64(1)

    def grams(self, x: np.ndarray) -> np.ndarray:
        """A hash of every k bytes, by doubling; the top bit is set for those that step back."""
        h, n, i = self.byte[x], 1, 0
        while n < self.k:
            right = h[n:]
            h = h[:-n] * self.mul[i, 0] + (right ^ (right >> np.uint64(29))) * self.mul[i, 1]
            n, i = 2 * n, i + 1
        h = (h ^ (h >> np.uint64(31))) >> np.uint64(1)
        if len(self.hot):
            at = np.searchsorted(self.hot, h)
            at[at == len(self.hot)] = 0
            h[self.hot[at] == h] |= np.uint64(1 << 63)
        return h

    def _least(self, x: np.ndarray) -> np.ndarray:
        """The least of each window's values."""
        out, n = x, 1
        while 2 * n <= self.w:
            out, n = np.minimum(out[:-n], out[n:]), 2 * n
        return np.minimum(out[: len(x) - self.w + 1], out[self.w - n :]) if n < self.w else out

    def runs(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(gram hash, anchor, first and last window) of the runs in ``x``, which holds texts that begin at ``starts``; positions are in ``x``."""
        ends = np.append(starts[1:], len(x))
        out = []
        for a in range(0, len(x) - self.length + 1, SEGMENT):
            part = x[a : a + SEGMENT + self.length - 1]
            g = self.grams(part)
            at = (self._least((g & ~_POS) | np.arange(len(g), dtype=np.uint64)) & _POS).astype(np.int64)
            new = np.append(True, at[1:] != at[:-1])
            for b in (starts, ends - self.length + 1):  # where a text's windows begin, and end
                b = b[(b >= a) & (b < a + len(at))] - a
                new[b] = True
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:] - 1, len(at) - 1)
            inside = lo + a + self.length <= ends[np.searchsorted(starts, lo + a, "right") - 1]
            lo, hi = lo[inside], hi[inside]
            out.append((g[at[lo]], at[lo] + a, lo + a, hi + a))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))


def entry_type(length: int, k: int) -> np.dtype:
    """An entry: where its anchor stands, how far to the left its windows reach at least and at most, and the bytes from the anchor on and, reversed, before it."""
    return np.dtype([("uid", "<i8"), ("at", "<i8"), ("least", "u1"), ("most", "u1"), ("right", f"S{length}"), ("left", f"S{max(1, length - k)}")])


def _bytes(strings: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(strings).view(np.uint8).reshape(len(strings), -1)


def _sorted(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings, and how many bytes each shares with the one before it there. Runs already in order are merged, not sorted."""
    order = np.argsort(strings, kind="stable")
    rows = _bytes(strings[order])
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.append(0, common)


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the maximal stretches that are true in the rows of a matrix."""
    flat = np.zeros((len(mask), mask.shape[1] + 1), bool)
    flat[:, :-1] = mask
    edge = np.diff(flat.ravel().astype(np.int8), prepend=0)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a // flat.shape[1], a % flat.shape[1], (b - 1) % flat.shape[1]


def _reach(e: np.ndarray, width: int) -> np.ndarray:
    """Which windows entries have, by how far they reach to the left."""
    left = np.arange(width)
    return (e["least"][:, None] <= left) & (left <= e["most"][:, None])


def _repeats(e: np.ndarray, length: int, k: int) -> np.ndarray:
    """Which windows of ``e``, in order of place, have an equal before them: a row an entry, a column a reach to the left."""
    width = length - k + 1
    out = np.zeros((len(e), width), bool)
    right, common = _sorted(e["right"])
    group = np.empty(len(e), np.int64)
    group[right] = np.cumsum(common < k)
    alone = np.bincount(group)[group] < 2
    if alone.any():
        some = np.flatnonzero(~alone)
        if len(some):
            out[some] = _repeats(e[some], length, k)
        return out
    left, before = _sorted(e["left"])
    lo, hi, a, b = e["least"], e["most"], np.empty(len(e), np.int64), np.empty(len(e), np.int64)
    for reach in range(width):
        at = np.flatnonzero((lo <= reach) & (reach <= hi))
        if len(at) < 2:
            continue
        a[right] = np.cumsum(common < length - reach)
        b[left] = np.cumsum(before < reach)
        key = b[at] * (len(e) + 1) + a[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        out[at[order[1:][key[1:] == key[:-1]]], reach] = True
    return out


def _first_ones(e: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """What is left of entries without repeated windows."""
    row, lo, hi = _stretches(_reach(e, repeated.shape[1]) & ~repeated)
    out = e[row]
    out["least"], out["most"] = lo, hi
    return out


def _where(e: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, first, last) window of the repeats."""
    row, lo, hi = _stretches(repeated)
    return e["uid"][row], e["at"][row] - hi, e["at"][row] - lo


class Family:
    """Levels of entries in the order of their suffixes. ``add`` returns where a window stands that turned out to have an earlier equal, in the batch or in a level."""

    def __init__(self, length: int = LENGTH, k: int = K) -> None:
        self.length, self.k, self.levels = length, k, []

    def _settled(self, e: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((e["at"], e["uid"]))
        repeated = np.empty((len(e), self.length - self.k + 1), bool)
        repeated[order] = _repeats(e[order], self.length, self.k)
        found.append(_where(e, repeated))
        return repeated

    def add(self, batch: np.ndarray) -> list[tuple]:
        found: list[tuple] = []
        batch = _first_ones(batch, self._settled(batch, found))
        short = f"S{self.k}"
        for i, level in enumerate(self.levels):
            heads, own = level["right"].astype(short), batch["right"].astype(short)
            ours = np.isin(own, heads)
            if not ours.any():
                continue
            theirs = np.isin(heads, own)
            both, n = np.concatenate([level[theirs], batch[ours]]), int(theirs.sum())
            repeated = self._settled(both, found)
            self.levels[i] = self._merged(level[~theirs], _first_ones(both[:n], repeated[:n]))
            batch = np.concatenate([batch[~ours], _first_ones(both[n:], repeated[n:])])
        self.levels.append(batch[np.argsort(batch["right"], kind="stable")])
        i = len(self.levels) - 1
        while i > 0:  # levels before the last can have lost entries
            if len(self.levels[i - 1]) <= 2 * len(self.levels[i]):
                self.levels[i - 1 : i + 1] = [self._merged(*self.levels[i - 1 : i + 1])]
                i = len(self.levels)
            i -= 1
        return found

    @staticmethod
    def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.concatenate([a, b])
        return both[np.argsort(both["right"], kind="stable")]


class _Texts:
    """The texts of a map task's batch, one after the other, and their runs."""

    def __init__(self, parts: list[tuple[int, int, bytes]], anchors: Anchors) -> None:
        self.length, self.pad = anchors.length, max(1, anchors.length - anchors.k)
        sizes = np.array([len(d) for _, _, d in parts], np.int64)
        starts = np.append(0, np.cumsum(sizes)[:-1])
        self.x = np.frombuffer(b"".join([bytes(self.pad), *(d for _, _, d in parts), bytes(self.length)]), np.uint8)
        self.gram, self.at, lo, hi = anchors.runs(self.x[self.pad : len(self.x) - self.length], starts)
        of = np.searchsorted(starts, self.at, "right") - 1
        shift = np.array([a for _, a, _ in parts], np.int64)[of] - starts[of]
        self.uid = np.array([u for u, _, _ in parts], np.int64)[of]
        self.lo, self.hi, self.place = lo + shift, hi + shift, self.at + shift

    def entries(self, rows: np.ndarray, kind: np.dtype) -> np.ndarray:
        out = np.empty(len(rows), kind)
        at = self.at[rows] + self.pad
        out["uid"], out["at"] = self.uid[rows], self.place[rows]
        out["least"], out["most"] = self.place[rows] - self.hi[rows], self.place[rows] - self.lo[rows]
        right = sliding_window_view(self.x, self.length)[at]
        right[np.arange(self.length) >= (self.length - out["least"].astype(np.int64))[:, None]] = 0
        left = np.ascontiguousarray(sliding_window_view(self.x, self.pad)[at - self.pad][:, ::-1])
        left[np.arange(self.pad) >= out["most"][:, None]] = 0
        out["right"], out["left"] = right.view(f"S{self.length}").ravel(), left.view(f"S{self.pad}").ravel()
        return out


def _joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Window ranges of documents, in order of place and joined where they touch or overlap."""
    out = np.empty(len(doc), RANGE)
    if not len(doc):
        return out
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.append(True, doc[1:] != doc[:-1])
    # ends so far in a document: all of a later one lie behind, so that one running maximum does
    base = np.append(0, np.cumsum(np.maximum.reduceat(hi, np.flatnonzero(new)) + 1)[:-1])[np.cumsum(new) - 1]
    ends = np.maximum.accumulate(hi + base) - base
    at = np.flatnonzero(new | np.append(True, lo[1:] > ends[:-1] + 1))
    out = out[: len(at)]
    out["uid"], out["lo"], out["hi"] = doc[at], lo[at], ends[np.append(at[1:] - 1, len(doc) - 1)]
    return out


def _places(kind: int, shards: int, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple]:
    """A row for each bucket of documents: their window ranges."""
    r = _joined(doc, lo, hi)
    return _rows(r, (r["uid"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards), kind, RANGE.names)


def _rows(entries: np.ndarray, shard: np.ndarray, kind: int, fields: tuple, pack: Callable = bytes) -> list[tuple]:
    """A row for each shard: its entries, field by field."""
    if not len(entries):
        return []
    order = np.argsort(shard, kind="stable")
    entries, shard = entries[order], shard[order].astype(np.int64)
    cuts = np.append(np.append(0, np.flatnonzero(np.diff(shard)) + 1), len(shard)).tolist()
    return [(int(shard[i]), kind, j - i, pack(b"".join(np.ascontiguousarray(entries[f][i:j]).tobytes() for f in fields))) for i, j in zip(cuts, cuts[1:], strict=False)]


def _dealt(entries: np.ndarray, by: np.ndarray, shards: int, fields: tuple, pack: Callable = bytes) -> list[tuple]:
    """Entries, in order of place, for the shards of their grams."""
    order = np.lexsort((entries["at"], entries["uid"]))
    return _rows(entries[order], (by[order] >> np.uint64(20)) % np.uint64(shards), ENTRY, fields, pack)


def _undealt(blob: bytes, n: int, kind: np.dtype, fields: tuple) -> np.ndarray:
    out, at = np.empty(n, kind), 0
    for f in fields:
        out[f] = np.frombuffer(blob, kind[f], n, at)
        at += n * kind[f].itemsize
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["shard", "kind", "n", "blob"])


def _by_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document and kind of what a bucket holds: its window ranges as pairs of 64-bit integers."""
    held: dict[int, list] = {REPEAT: [], OPEN: []}
    for pdf in batches:
        for kind, n, blob in zip(pdf["kind"], pdf["n"], pdf["blob"], strict=True):
            if kind == HOT:
                yield pd.DataFrame({"uid": [0], "kind": [HOT], "n": [n], "blob": [blob]})
            else:
                held[kind].append(_undealt(blob, n, RANGE, RANGE.names))
    for kind, got in held.items():
        if got:
            r = np.concatenate(got)
            r = _joined(r["uid"], r["lo"], r["hi"])
            cuts = np.flatnonzero(np.append(True, np.diff(r["uid"]) != 0))
            pairs = np.stack([r["lo"], r["hi"]], 1)
            wide = np.add.reduceat(r["hi"] - r["lo"] + 1, cuts)
            blobs = [p.tobytes() for p in np.split(pairs, cuts[1:])]
            yield pd.DataFrame({"uid": r["uid"][cuts], "kind": kind, "n": wide, "blob": blobs})


def _pairs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, 2)


def _batched(pieces: Callable, flush: Callable) -> Callable:
    """A mapInPandas function: ``pieces`` yields (uid, place, bytes) for a row, ``flush`` turns a batch of them into rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for piece in pieces(row):
                    held.append(piece)
                    n += len(piece[2])
                    if n >= BATCH:
                        yield _frame(flush(held))
                        held, n = [], 0
        if held:
            yield _frame(flush(held))

    return run


#: What the first pass sends of a run: its gram, its place, how far it reaches, and how many of its anchor the batch has.
PLACE = np.dtype([("gram", "<u8"), ("uid", "<i8"), ("at", "<u4"), ("least", "u1"), ("most", "u1"), ("count", "<u4")])


def repeated_windows(docs: DataFrame, total: int, length: int = LENGTH, k: int = K) -> DataFrame:
    """``(uid, blob)``: where the windows start that also start earlier, as pairs (first, last) of 64-bit integers.

    ``docs`` has ``uid``, distinct longs that give the order of documents, and ``data``, binary of ``total`` bytes in all. A document can have several rows, with ranges that overlap.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = entry_type(length, k)
    n = max(parts, -(-total * PLACE.itemsize // (K * SHARD)))
    #: Places from which on an anchor steps back. At most 128 anchors a shard have so many.
    frequent = max(FREQUENT, total // (128 * n))
    made: dict = {}

    def anchors(hot=None) -> Anchors:
        if "a" not in made:
            made["a"] = Anchors(length, k, hot)
        return made["a"]

    def whole(row) -> Iterator[tuple]:
        """A document in pieces that overlap by a window less a byte."""
        for at in range(0, max(1, len(row.data) - length + 1), BATCH):
            yield row.uid, at, row.data[at : at + BATCH + length - 1]

    def settle(texts: _Texts, rows: list[tuple], shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose windows are the first of the batch, and their grams; runs alone with their anchor have no bytes yet, only their row number in ``at``."""
        _, inverse, counts = np.unique(texts.gram, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[inverse] > 1)
        several = several[np.lexsort((texts.place[several], texts.uid[several]))]
        e = texts.entries(several, kind)
        repeated = _repeats(e, length, k) if len(e) else np.zeros((0, length - k + 1), bool)
        rows += _places(REPEAT, shards, *_where(e, repeated))
        row, lo, hi = _stretches(_reach(e, repeated.shape[1]) & ~repeated)
        out = e[row]
        out["least"], out["most"] = lo, hi
        return np.flatnonzero(counts[inverse] == 1), out, texts.gram[several[row]]

    def first_out(held: list) -> list[tuple]:
        texts, rows = _Texts(held, anchors()), []
        alone, e, gram = settle(texts, rows, n)
        send = np.zeros(len(alone) + len(e), PLACE)
        one, more = send[: len(alone)], send[len(alone) :]
        one["gram"], one["uid"], one["at"] = texts.gram[alone], texts.uid[alone], texts.place[alone]
        one["least"], one["most"], one["count"] = texts.place[alone] - texts.hi[alone], texts.place[alone] - texts.lo[alone], 1
        _, first, inverse, counts = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
        more["gram"], more["uid"], more["at"], more["least"], more["most"] = gram, e["uid"], e["at"], e["least"], e["most"]
        more["count"] = counts[inverse] if len(e) else 0
        many = more["count"] > FEW
        rows += _places(OPEN, n, more["uid"][many], more["at"][many].astype(np.int64) - more["most"][many], more["at"][many].astype(np.int64) - more["least"][many])
        keep = ~many
        keep[first[counts > FEW]] = True
        send = np.concatenate([one, more[keep]])
        return rows + _dealt(send, send["gram"], n, PLACE.names)

    def first_judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, batch = [], []
        for pdf in batches:
            entry = pdf["kind"] == ENTRY
            yield pdf[~entry]
            for m, blob in zip(pdf["n"][entry], pdf["blob"][entry], strict=True):
                got.append(_undealt(blob, m, PLACE, PLACE.names))
                batch.append(m)
        if not got:
            return
        e, of = np.concatenate(got), np.repeat(np.arange(len(batch)), batch)
        order = np.lexsort((of, e["gram"]))
        e, of = e[order], of[order]
        new = np.append(True, e["gram"][1:] != e["gram"][:-1])
        group = np.cumsum(new) - 1
        batches_of = np.bincount(group, weights=new | np.append(True, of[1:] != of[:-1]))
        sizes = np.bincount(group, weights=np.where(e["count"] > FEW, e["count"], 1))
        opened = (batches_of[group] > 1) & (e["count"] <= FEW)
        at = e["at"][opened].astype(np.int64)
        rows = _places(OPEN, n, e["uid"][opened], at - e["most"][opened], at - e["least"][opened])
        hot = e["gram"][new][sizes >= frequent]
        yield _frame(rows + ([(0, HOT, len(hot), hot.tobytes())] if len(hot) else []))

    # A shard is a partition, and so is a bucket of documents, whose rows only pass through shards.
    dealt = lambda df, n: df.repartitionById(n, F.col("shard"))
    gathered = lambda df, n: dealt(df, n).mapInPandas(_by_document, "uid long, kind int, n long, blob binary")

    first = written(gathered(dealt(docs.mapInPandas(_batched(whole, first_out), ROWS), n).mapInPandas(first_judged, ROWS), n))
    hot = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["blob"], "<u8") for r in first.where(F.col("kind") == HOT).select("blob").toLocalIterator())])
    wide = first.where(F.col("kind") == OPEN).agg(F.sum("n")).first()[0] or 0
    #: A run has some 17 windows or more on average, so an entry for each 16 is a safe guess.
    m = max(parts, -(-(wide // 16) * kind.itemsize // SHARD))

    def opened(row) -> Iterator[tuple]:
        for lo, hi in _pairs(row.blob).tolist():
            for at in range(lo, hi + 1, BATCH):
                yield row.uid, at, row.data[at : min(at + BATCH, hi + 1) + length - 1]

    def second_out(held: list) -> list[tuple]:
        texts, rows = _Texts(held, anchors(hot)), []
        alone, e, gram = settle(texts, rows, m)
        send = np.concatenate([texts.entries(alone, kind), e])
        return rows + _dealt(send, np.concatenate([texts.gram[alone], gram]), m, kind.names, zstandard.ZstdCompressor(3).compress)

    def second_judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, held, size = Family(length, k), [], 0

        def settled() -> pd.DataFrame:
            found = index.add(np.concatenate(held))
            return _frame(_places(REPEAT, m, *map(np.concatenate, zip(*found, strict=True))))

        for pdf in batches:
            entry = pdf["kind"] == ENTRY
            yield pdf[~entry]
            for count, blob in zip(pdf["n"][entry], pdf["blob"][entry], strict=True):
                held.append(_undealt(zstandard.decompress(blob), count, kind, kind.names))
                size += count
                if size >= ENTRIES:
                    yield settled()
                    held, size = [], 0
        if held:
            yield settled()

    ranges = first.where(F.col("kind") == OPEN).select("uid", "blob")
    second = docs.join(ranges, "uid").select("uid", "data", "blob").mapInPandas(_batched(opened, second_out), ROWS)
    judged = gathered(dealt(second, m).mapInPandas(second_judged, ROWS), m)
    return first.where(F.col("kind") == REPEAT).select("uid", "blob").union(judged.select("uid", "blob"))


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, k: int = K) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: the byte ranges removed from each document, and its other bytes.

    A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a document of smaller id, or earlier in its own. Nulls count as empty; texts shorter than ``length`` stay whole. Rows that share an id, or have none (they come last), count as documents of their own, ordered by text. ``spans`` are maximal and hold their end exclusively. Other columns aren't read. The result doesn't depend on how ``docs`` is split into partitions.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"))
    rows, ids, distinct, total = base.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id"), F.sum(F.length("data"))).first()
    own = base.withColumn("uid", F.col("doc_id")) if rows == ids == distinct else written(ranked(base, [F.col("doc_id").asc_nulls_last(), F.col("data")], "uid"))
    found = repeated_windows(own.select("uid", "data"), total or 0, length, k).groupBy("uid").agg(F.collect_list("blob").alias("blobs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept, spans = [], []
            for data, blobs in zip(pdf["data"], pdf["blobs"], strict=True):
                if blobs is None:
                    kept.append(data)
                    spans.append([])
                    continue
                at, parts, gone = 0, [], []
                for lo, hi in sorted(p for b in blobs for p in _pairs(b).tolist()):
                    if gone and lo <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], hi + length)
                    else:
                        gone.append([lo, hi + length])
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(d) for d in pdf["data"]], "spans": spans, "kept": kept})

    return own.join(found, "uid", "left").select("doc_id", "data", "blobs").mapInPandas(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
