"""Media columns in Matroska: writing 8-bit samples, and parsing elements, clusters, lacing and cues into packet tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, RATE = 576, 8000
FRAME_MS = FRAME * 1000 // RATE
LACE, BLOCKS = 8, 32
PAD = b"\xff"
# Element ids of the public EBML and Matroska specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_IDS, EBML_SIZES, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, SAMPLING, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE_BLOCK, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EVERY, REFERENCE, SEEKS, TAGS, CHAPTERS, ATTACHMENTS = 0x23E383, 0xFB, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: Elements that can't stand in a cluster, so that one of unknown size ends before them; nor, for the first two, in a segment.
_OUTSIDE = {EBML, SEGMENT, CLUSTER, CUES, INFO, TRACKS, SEEKS, TAGS, CHAPTERS, ATTACHMENTS}
#: Bytes of media or payload that a task hands on at a time.
_OUT = 1 << 22
_INSIDE = {SEGMENT, CLUSTER, GROUP, TRACKS, TRACK, AUDIO, CUES, CUE, CUE_PLACE, INFO}


def _vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _vint(len(data)) + data


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _head() -> bytes:
    return _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_IDS, 4) + _uint(EBML_SIZES, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))


def write(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples; ``payload`` is a positive multiple of ``FRAME`` long.

    Frames of ``FRAME`` bytes go up to ``LACE`` to a block, with fixed-size lacing, and ``BLOCKS`` blocks to a cluster; a cue points to each cluster.
    """
    frames = len(payload) // FRAME
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", frames * FRAME_MS)) + _element(MUXER, b"veridge") + _element(WRITER, b"veridge"))
    tracks = _element(TRACKS, _element(TRACK, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACING, 1) + _uint(EVERY, FRAME_MS * 1_000_000) + _element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    for c in range(0, frames, LACE * BLOCKS):
        body = [_uint(TIME, c * FRAME_MS)]
        for b in range(c, min(frames, c + LACE * BLOCKS), LACE):
            n = min(LACE, frames - b)
            head = b"\x81" + struct.pack(">hB", (b - c) * FRAME_MS, 0x84 if n > 1 else 0x80) + (bytes([n - 1]) if n > 1 else b"")
            body.append(_element(SIMPLE_BLOCK, head + payload[b * FRAME : (b + n) * FRAME]))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE, _uint(CUE_TIME, c * FRAME_MS) + _element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _head() + _element(SEGMENT, b"".join(parts))


def _number(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int | None, int]:
    """A variable-length integer at ``at`` and where it ends; an unknown size is None."""
    first = data[at] if at < end else 0
    width = 9 - first.bit_length()
    if width > 8 or at + width > end:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        n &= (1 << 7 * width) - 1
        if n == (1 << 7 * width) - 1:
            return None, at + width
    return n, at + width


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of content, end, depth) of every element, parents first. A segment or cluster of unknown size is given its parent's end; what it holds ends before the first element that can't be in it."""
    yield from _walk(data, at, len(data) if end is None else end, 0, frozenset())


def _walk(data: bytes, at: int, end: int, depth: int, until: frozenset | set) -> Iterator[tuple[int, int, int, int]]:
    """The elements from ``at`` up to ``end`` or one of ``until``; returns where that is."""
    while at < end:
        ident, body = _number(data, at, end, True)
        if ident in until:
            return at
        size, body = _number(data, body, end, False)
        if size is None and ident not in (SEGMENT, CLUSTER):
            raise ValueError(f"element {ident:x} at byte {at} has no size")
        stop = end if size is None else body + size
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} is cut off")
        yield ident, body, stop, depth
        if ident in _INSIDE:
            own = frozenset() if size is not None else {EBML, SEGMENT} if ident == SEGMENT else _OUTSIDE
            reached = yield from _walk(data, body, stop, depth + 1, own)
            stop = reached if size is None else stop
        at = stop
    return at


def _laced(data: bytes, at: int, end: int, how: int) -> list[tuple[int, int]]:
    """The byte ranges of a block's frames: no lacing, Xiph (1), fixed-size (2) or EBML (3)."""
    if not how:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if how == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed-size lacing doesn't divide the block")
        return [(at + i * size, at + (i + 1) * size) for i in range(n)]
    sizes = []
    for i in range(n - 1):
        if how == 1:
            size = 0
            while True:
                size, byte, at = size + data[at], data[at], at + 1
                if byte < 255:
                    break
        else:
            start = at
            size, at = _number(data, at, end, False)
            size = (1 << 7 * (at - start)) - 1 if size is None else size
            if i:
                size = sizes[-1] + size - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing exceeds the block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def packets(data: bytes) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Packets (track, nanoseconds, first byte, end, key frame, cluster) and cues (nanoseconds, track, cluster position).

    Times are the block's, in the segment's scale. The frames of a laced block follow each other by the track's default duration; without one they share its time. A block in a group is a key frame if it refers to no other.
    """
    out, cues, time, cluster, cue, base, scale, number, every, group = [], [], 0, -1, [0, 0, 0], 0, 1_000_000, 0, {}, 0
    value = lambda at, end: int.from_bytes(data[at:end], "big")
    for ident, at, end, _ in elements(data):
        if ident == SEGMENT:
            base = at
        elif ident == SCALE:
            scale = value(at, end)
        elif ident == TRACK:
            number = 0
        elif ident == NUMBER:
            number = value(at, end)
            if 0 in every:  # the duration came first
                every[number] = every.pop(0)
        elif ident == EVERY:
            every[number] = value(at, end)
        elif ident == CLUSTER:
            cluster, time = cluster + 1, 0
        elif ident == TIME:
            time = value(at, end)
        elif ident == GROUP:
            group = len(out)
        elif ident == REFERENCE:
            out[group:] = [(*p[:4], False, p[5]) for p in out[group:]]
        elif ident in (SIMPLE_BLOCK, BLOCK):
            track, p = _number(data, at, end, False)
            shift, flags = struct.unpack_from(">hB", data, p)
            start, step = (time + shift) * scale, every.get(track, 0)
            key = ident == BLOCK or bool(flags & 0x80)
            out += [(track, start + i * step, a, b, key, cluster) for i, (a, b) in enumerate(_laced(data, p + 3, end, flags >> 1 & 3))]
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(ident)] = value(at, end)
            if ident == CUE_CLUSTER:
                cues.append((cue[0] * scale, cue[1], base + cue[2]))
    return out, cues


def feature(payload: bytes, found: list[tuple], cues: list) -> str:
    """Counts of packets, clusters and cues, duration, and mean, deviation and sign changes of the samples about the mid level."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    mean, var = x.mean(), x.var()
    turns = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"packets={len(found)};clusters={found[-1][5] + 1};cues={len(cues)};ms={len(payload) * 1000 // RATE};mean={mean:.3f};dev={var**0.5:.3f};turns={turns}"


def _portions(pdf: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """Rows in portions of about ``_OUT`` bytes of a column, one row at least."""
    first, held = 0, 0
    for i, data in enumerate(pdf[column]):
        held += len(data)
        if held >= _OUT:
            yield pdf.iloc[first : i + 1]
            first, held = i + 1, 0
    if first < len(pdf):
        yield pdf.iloc[first:]


def store(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every whole text as UTF-8, padded with 255 to a positive multiple of ``FRAME``, as a Matroska file.

    A null text counts as empty. Equal texts give equal files; repeated rows and null ids stay as they are; an empty table gives no rows. Other columns aren't read. Some megabytes of files, or one file, are held at a time beside their batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _portions(batch, "data"):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(d) for d in pdf["data"]], "media": [write(d.ljust(max(1, -(-len(d) // FRAME)) * FRAME, PAD)) for d in pdf["data"]]})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"))
    return own.mapInPandas(run, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with ``payload``, read back packet by packet from the file, and ``feature``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _portions(batch, "media"):
                payloads, features = [], []
                for data in pdf["media"]:
                    found, cues = packets(data)
                    payload = b"".join([data[p[2] : p[3]] for p in found])
                    payloads.append(payload)
                    features.append(feature(payload, found, cues))
                yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), payload=payloads, feature=features)

    return media.mapInPandas(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet of each file in ``media`` (doc_id, media): track, nanoseconds, byte range in the file, key frame, cluster."""
    columns = ["packet", "track", "nanoseconds", "first_byte", "end_byte", "key", "cluster"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _portions(batch, "media"):
                each = [packets(data)[0] for data in pdf["media"]]
                rows = pd.DataFrame([(i, *p) for found in each for i, p in enumerate(found)], columns=columns)
                rows.insert(0, "doc_id", pdf["doc_id"].astype("Int64").repeat([len(f) for f in each]).array)
                yield rows

    return media.select("doc_id", "media").mapInPandas(run, "doc_id long, packet long, track long, nanoseconds long, first_byte long, end_byte long, key boolean, cluster long")
