"""Packing documents into sequences: a fixed number of open windows per partition, best fit, merged leftovers."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridge.runtime import written

LENGTH = 4096
WINDOWS = 64
#: A window with less room than this is closed as it is; one with more is filled with the head of the next document.
LEAST_CUT = 32
MERGED = 64
END = 2
#: Words that are remembered, bytes of text that are tokenized at a time, bytes of a word that the memory's keys hold.
_CACHE, _BATCH, _KEY = 600_000, 1 << 20, 32
_TAIL = ".,;:!?)]*#%&$\""
#: White space of the tokenizer beyond ASCII; unlike Python's it leaves out U+001C to U+001F.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, window long, offset long, full boolean"


class WordTokens:
    """Ids of whole texts by a tokenizer of which no token crosses white space, remembered word by word.

    Words are found and looked up by arrays: a word of at most ``_KEY`` bytes is its bytes, as four integers, that the memory has in order of a hash; equal hashes are compared. New and longer words are encoded: those of letters in lower case, as one token sequence that ends with a token of ``suffix``, many as one text that is cut after those tokens; those of letters with a tail of ``_TAIL`` marks as both; others by themselves. When the memory gets large, it forgets what wasn't met again since it was added or last kept, which costs time only.
    """

    def __init__(self, path: str, suffix: str = "</w>") -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.kind = np.dtype("<u2" if len(vocab) <= 1 << 16 else "<u4")
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.keys = np.zeros(0, "<u8"), np.zeros((_KEY // 8, 0), "<u8")
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.again = np.zeros(0, bool)

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.again)
        if not 0 < len(keep) <= _CACHE // 2:
            self._forget()
            return
        first, count = self.first[keep], self.count[keep]
        ends = np.cumsum(count)
        self.ids = self.ids[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]
        self.hashes, self.keys, self.first, self.count = self.hashes[keep], self.keys[:, keep], ends - count, count
        self.again = np.zeros(len(keep), bool)

    def _single(self, words: list[str], into: dict[str, bytes]) -> None:
        for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False), strict=True):
            into[w] = np.array(e.ids, dtype=self.kind).tobytes()

    def _lower(self, words: list[str], into: dict[str, bytes]) -> None:
        """Words of lower-case letters."""
        size = self.kind.itemsize
        groups = [words[i : i + 128] for i in range(0, len(words), 128)]
        for g, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(g):  # not one sequence a word after all
                self._single(g, into)
                continue
            data, cuts = ids.tobytes(), (ends * size).tolist()
            into.update(zip(g, [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True))

    def encoded(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as bytes."""
        known: dict[str, bytes] = {}
        lower = [w for w in words if w.isalpha() and w.islower()]
        seen = set(lower)
        parts, odd = [], []
        for w in [w for w in words if w not in seen]:
            core = w.rstrip(_TAIL)
            low = core.lower()
            if low.isalpha() and (core.isascii() or "\u03a3" not in core):
                parts.append((w, low, w[len(core) :]))
            else:
                odd.append(w)
        more = {low for _, low, _ in parts} - seen
        self._lower([*lower, *more], known)
        self._single(list({*odd, *(tail for *_, tail in parts if tail)}), known)
        known.update([(w, known[low] + known[tail] if tail else known[low]) for w, low, tail in parts])
        return [known[w] for w in words]

    def _remember(self, hashes: np.ndarray, keys: np.ndarray, ids: list[bytes]) -> None:
        """Add words, sorted by hash and with hashes that the memory hasn't."""
        count = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        first = len(self.ids) + np.append(0, np.cumsum(count)[:-1])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.kind)])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.keys = every[order], np.concatenate([self.keys, keys], axis=1)[:, order]
        self.first, self.count = np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]
        self.again = np.concatenate([self.again, np.zeros(len(hashes), bool)])[order]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts = [(t if t.isascii() else _WIDE_SPACE.sub(" ", t)).encode() for t in texts]
        data = b" " + b" ".join(parts) + b" " + bytes(_KEY)
        x = np.frombuffer(data, np.uint8)[: len(data) - _KEY]
        edges = np.flatnonzero(np.diff(_SPACE[x])) + 1
        a, n = edges[::2], edges[1::2] - edges[::2]
        words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        keys = np.zeros((_KEY // 8, len(a)), "<u8")
        h = n.astype("<u8")
        for i in range(_KEY // 8):
            at = np.flatnonzero(n > 8 * i) if i else slice(None)
            keys[i, at] = words[a[at] + 8 * i] & _MASKS[np.minimum(n[at] - 8 * i, 8)]
            h = (h + keys[i]) * np.uint64(_MIX[i])
            h ^= h >> np.uint64(31)
        order = np.argsort(h)
        u = h[order]
        new = np.append(True, u[1:] != u[:-1])[: len(u)]
        of = np.empty(len(a), np.int64)
        of[order] = np.cumsum(new) - 1
        u, some = u[new], order[new]
        alike = n <= _KEY
        for k in keys:
            alike &= k == k[some][of]

        def found() -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(self.hashes, u)
            at[at == len(self.hashes)] = 0
            same = self.hashes[at] == u if len(self.hashes) else np.zeros(len(u), bool)
            return at, same

        def text(rows: np.ndarray) -> list[str]:
            return b" ".join([data[i:j] for i, j in zip(a[rows].tolist(), (a[rows] + n[rows]).tolist(), strict=True)]).decode().split(" ") if len(rows) else []

        at, same = found()
        self.again[at[same]] = True
        if len(self.hashes) + int((~same).sum()) > _CACHE:
            self._shrink()
            at, same = found()
        todo = np.flatnonzero(~same & (n[some] <= _KEY))
        if len(todo):
            self._remember(u[todo], keys[:, some[todo]], self.encoded(text(some[todo])))
            at, same = found()
        for k, own in zip(self.keys, keys, strict=True):
            same &= k[at] == own[some] if len(k) else False
        alike &= same[of]
        first, count, ids = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), self.ids
        if len(self.hashes):
            first, count = self.first[at][of], self.count[at][of]
        odd = np.flatnonzero(~alike)
        if len(odd):  # long words, and any whose hash another word has
            own = text(odd)
            known = dict(zip(names := list(dict.fromkeys(own)), self.encoded(names), strict=True))
            extra = [known[w] for w in own]
            count[odd] = [len(e) // self.kind.itemsize for e in extra]
            first[odd] = len(ids) + np.cumsum(count[odd]) - count[odd]
            ids = np.concatenate([ids, np.frombuffer(b"".join(extra), self.kind)])
        ends = np.cumsum(count)
        out = ids[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        starts = np.cumsum([1, *(len(p) + 1 for p in parts)])[:-1]
        cuts = np.append(0, ends)[np.searchsorted(a, starts[1:])]
        return np.split(out, cuts) if texts else []


_MADE: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    """The tokenizer of this process; the next task of a worker finds the words that the last one met."""
    if path not in _MADE:
        _MADE[path] = WordTokens(path)
    return _MADE[path]


class _Packer:
    """The open windows of one partition, sorted by what they hold."""

    def __init__(self, part: int, length: int, windows: int, least_cut: int) -> None:
        self.part, self.length, self.windows, self.least_cut = part, length, windows, least_cut
        self.open: list[tuple[int, int]] = []  # (tokens held, window)
        self.held: dict[int, list[tuple]] = {}
        self.next = 0
        self.out: list[tuple] = []

    def _put(self, window: int, held: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.held.setdefault(window, []).append((doc, start, len(ids), ids.tobytes(), total, self.part, window, held))

    def _close(self, window: int, full: bool = True) -> None:
        self.out += [(*p, full) for p in self.held.pop(window)]

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while at < total:
            left = total - at
            if left >= self.length:
                self._put(self.next, 0, doc, at, ids[at : at + self.length], total)
                self._close(self.next)
                self.next, at = self.next + 1, at + self.length
                continue
            k = bisect.bisect_right(self.open, (self.length - left, 1 << 62)) - 1
            if k >= 0:
                held, window = self.open.pop(k)
                self._put(window, held, doc, at, ids[at:], total)
                if held + left == self.length:
                    self._close(window)
                else:
                    bisect.insort(self.open, (held + left, window))
                return
            if len(self.open) < self.windows:
                self._put(self.next, 0, doc, at, ids[at:], total)
                bisect.insort(self.open, (left, self.next))
                self.next += 1
                return
            held, window = self.open.pop()
            if (room := self.length - held) >= self.least_cut:
                self._put(window, held, doc, at, ids[at : at + room], total)
                at += room
            self._close(window)

    def end(self) -> None:
        for _, window in self.open:
            self._close(window, False)
        self.open = []

    def taken(self) -> pd.DataFrame:
        rows, self.out = self.out, []
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "part", "window", "offset", "full"]).astype({"doc_id": "Int64"})


def _merge(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Place leftover windows, largest first, into the fullest bins with room; a bin is named after its first window."""
    pdf = pdf.sort_values(["held", "part", "window"], ascending=[False, True, True], kind="stable")
    bins: list[tuple[int, int]] = []
    where, names = [], []
    for held, part, window in zip(pdf["held"], pdf["part"], pdf["window"], strict=True):
        k = bisect.bisect_right(bins, (length - held, 1 << 62)) - 1
        if k < 0:
            at, b = 0, len(names)
            names.append((part, window))
        else:
            at, b = bins.pop(k)
        if at + held < length:
            bisect.insort(bins, (at + held, b))
        where.append((part, window, *names[b], at))
    return pd.DataFrame(where, columns=["part", "window", "to_part", "to_window", "shift"])


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, windows: int = WINDOWS, least_cut: int = LEAST_CUT, end_id: int | None = END) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: the pieces of all documents in sequences of at most ``length`` tokens.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers. Each partition of ``docs`` keeps ``windows`` open windows: stretches of a whole window go out at once; the rest goes to the fullest window with room; if none has room, the fullest is emitted, after the document's head has filled it if at least ``least_cut`` ids fit. What stays open when a partition ends, ``windows`` windows at most, is merged over ``MERGED`` partitions at a time by sizes alone. Memory is bounded by the windows and one batch of texts.

    A null text counts as empty; an empty document still has its end token. Repeated rows are packed one by one. Null ids stay null. Other columns aren't read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tokens, packer = _tokens(tokenizer), _Packer(TaskContext.get().partitionId(), length, windows, least_cut)
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            upto = np.cumsum([len(t) for t in texts]) // _BATCH
            for i, j in itertools.pairwise([0, *(np.flatnonzero(np.diff(upto)) + 1), len(texts)]):
                for doc, ids in zip(batch["doc_id"].array[i:j], tokens(texts[i:j]), strict=True):
                    packer.add(doc, np.concatenate([ids.astype("<u4"), tail]))
                yield packer.taken()
        packer.end()
        yield packer.taken()

    pieces = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, PIECE))
    left = pieces.where("not full").groupBy("part", "window").agg(F.sum("length").alias("held")).withColumn("group", F.floor(F.col("part") / MERGED))
    moves = left.groupBy("group").applyInPandas(lambda pdf: _merge(pdf, length), "part long, window long, to_part long, to_window long, shift long")
    there = pieces.where("not full").join(moves, ["part", "window"])
    seq = lambda part, window: F.shiftleft(F.col(part), 40).bitwiseOR(F.col(window)).alias("sequence_id")
    cols = ["doc_id", "start", "length", "ids", "doc_tokens"]
    return pieces.where("full").select(*cols, seq("part", "window"), "offset").union(there.select(*cols, seq("to_part", "to_window"), (F.col("offset") + F.col("shift")).alias("offset")))
