"""Graph files: binary, text adjacency, edge lists, Matrix Market, Friendster lists, and property files."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridge.graph import Graph
from veridge.operators.statistics import prefix_sums
from veridge.runtime import ranked, written

#: Ids that one task decodes.
CHUNK = 1 << 20


def _bytes(spark: SparkSession, path: str, first: int, n: int) -> bytes:
    """Bytes of a file through Spark's file systems, for headers."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    p = hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(first)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _size(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def _record(size: int) -> int:
    """The largest record of whole words, a mebibyte at most, of which a file of ``size`` bytes has a whole number."""
    words, best = size // 4, 1
    for d in range(1, math.isqrt(words) + 1):
        if words % d == 0:
            best = max([best, *(x for x in (d, words // d) if x <= CHUNK // 4)])
    return 4 * best


def _slab(spark: SparkSession, path: str, first: int, n: int, kind: str, name: str) -> DataFrame:
    """``(eid, name)``: n numbers from byte ``first``. Spark's fixed-length records split the file between tasks; their bytes are decoded by the batch, as four-byte words, of which eight-byte numbers have two."""
    size = _size(spark, path)
    if size % 4:
        raise ValueError(f"{path} isn't made of four-byte words")
    length, words, start = _record(size), np.dtype(kind).itemsize // 4, first // 4
    code = np.dtype("<f4" if kind[1] == "f" else "<u4")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = (pdf["i"].to_numpy()[:, None] * (length // 4) + np.arange(length // 4)).ravel() - start
                x = np.frombuffer(b"".join(pdf["data"]), code)
                own = (at >= 0) & (at < n * words)
                yield pd.DataFrame({"word": at[own], "x": x[own]})

    rows = spark.createDataFrame(spark.sparkContext.binaryRecords(path, length).zipWithIndex(), "data binary, i long")
    df = rows.mapInPandas(decode, f"word long, x {'double' if code.kind == 'f' else 'long'}")
    if words == 1:
        return df.select(F.col("word").alias("eid"), F.col("x").alias(name))
    part = F.when(F.col("word") % 2 == 1, F.shiftleft("x", 32)).otherwise(F.col("x"))
    return df.groupBy(F.floor(F.col("word") / 2).alias("eid")).agg(F.sum(part).alias(name))


def _from_slabs(index: DataFrame, targets: DataFrame, n: int, m: int, weights: DataFrame | None, symmetric: bool) -> Graph:
    """A graph from row starts (eid: vertex, at) and targets (eid, dst). A vertex' start and the next one's give the positions of its edges, which meet the targets by position."""
    spark = targets.sparkSession
    nxt = index.select((F.col("eid") - 1).alias("eid"), F.col("at").alias("end"))
    rows = index.join(nxt, "eid", "left").select(F.col("eid").alias("src"), "at", F.coalesce("end", F.lit(m)).alias("end")).where(f"src < {n} and at < end")
    block = F.floor(F.col("at") / CHUNK)
    # a hub's positions are listed in blocks, so that none makes one huge array
    spans = rows.withColumn("block", F.explode(F.sequence(block, F.floor((F.col("end") - 1) / CHUNK))))
    starts = spans.select(F.greatest("at", F.col("block") * CHUNK).alias("from"), F.least("end", (F.col("block") + 1) * CHUNK).alias("to"), "src")
    pos = starts.select("src", F.explode(F.sequence("from", F.col("to") - 1)).alias("eid"))
    edges = pos.join(targets, "eid")
    if weights is not None:
        edges = edges.join(weights, "eid")
    return Graph(spark.range(n).toDF("id"), edges.drop("eid"), symmetric)


def read_binary(spark: SparkSession, path: str, symmetric: bool = False, weights: str | None = None) -> Graph:
    """A binary file of version 2 or 3: eight 64-bit numbers (version, 1, n, m, id size, index size, 0, 0), row starts, targets. ``weights`` is a file of 32-bit floats."""
    version, _, n, m, vid, eid, *_ = np.frombuffer(_bytes(spark, path, 0, 64), "<u8").tolist()
    if version not in (2, 3):
        raise ValueError(f"version {version}")
    starts = n + (version == 3)
    index = _slab(spark, path, 64, n, f"<u{eid}", "at")
    targets = _slab(spark, path, 64 + starts * eid, m, f"<u{vid}", "dst")
    return _from_slabs(index, targets, n, m, None if weights is None else _slab(spark, weights, 0, m, "<f4", "weight"), symmetric)


def read_config(spark: SparkSession, path: str) -> Graph:
    """A graph of version 4: a text of ``key = value;`` that names slabs of row starts, targets and perhaps a float weight per edge."""
    text = "\n".join(r[0] for r in spark.read.text(path).collect())  # a header of a dozen lines
    get = lambda k, d=None: (m := re.search(rf'\b{k}\s*[=:]\s*"?([^";\n]+)"?', text)) and m[1].strip() or d
    n, m, base = int(get("num_vertices")), int(get("num_edges")), path.rsplit("/", 1)[0]
    at = lambda k: f"{base}/{get(k)}" if not get(k).startswith("/") else get(k)
    index, targets = _slab(spark, at("index"), 0, n, f"<u{get('eid_size', '8')}", "at"), _slab(spark, at("edges"), 0, m, f"<u{get('vid_size', '4')}", "dst")
    w = _slab(spark, at("vertex_weights"), 0, m, "<f4", "weight") if get("vertex_weights") else None
    return _from_slabs(index, targets, n, m, w, get("symmetric", "false").lower() in ("true", "1"))


def load_graph(spark: SparkSession, path: str, **options) -> Graph:
    """By name and content: ``path.cfg``, Matrix Market, text adjacency, binary, or an edge list."""
    if path.endswith(".cfg") or _exists(spark, path + ".cfg"):
        return read_config(spark, path if path.endswith(".cfg") else path + ".cfg")
    head = _bytes(spark, path, 0, 24)
    if head.startswith(b"%%MatrixMarket"):
        return read_matrix_market(spark, path, **options)
    if head.startswith((b"AdjacencyGraph", b"WeightedAdjacencyGraph")):
        return read_adjacency(spark, path, **options)
    if head[:1] in b"\x02\x03" and head[1:8] == bytes(7):
        return read_binary(spark, path, **options)
    if head[:8] == b"\x01" + bytes(7) and len(head) >= 24:
        return read_galois(spark, path, **options)
    return read_edge_list(spark, path, **options)


def read_edge_list(spark: SparkSession, path: str, shift: int = 0, symmetric: bool = False) -> Graph:
    """Lines ``u v [w]``; lines that start with ``#`` or ``%`` are comments, ``shift`` is taken off ids. Vertices are 0 up to the largest id."""
    t = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*([#%]|$)"))).select(t.alias("t"))
    cols = [(F.get("t", F.lit(i)).cast("long") - shift).alias(c) for i, c in enumerate(("src", "dst"))]
    one = rows.select(F.size("t").alias("k")).take(1)
    has = bool(one) and one[0]["k"] > 2
    edges = rows.select(*cols, *([F.get("t", F.lit(2)).cast("double").alias("weight")] if has else []))
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return Graph(spark.range(0 if top is None else top + 1).toDF("id"), edges, symmetric)


def read_matrix_market(spark: SparkSession, path: str, shift: int = 1) -> Graph:
    """Matrix Market coordinates: pattern or real, general or symmetric; symmetric ones are mirrored but for self-edges."""
    head = _bytes(spark, path, 0, 4096).decode("latin-1").splitlines()
    kinds = head[0].lower().split()
    sizes = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(%|$)"))).limit(1).collect()[0][0].split()
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(%|$)"))).withColumn("n", F.monotonically_increasing_id()).where("n > 0").select(t.alias("t"))
    edges = rows.select((F.get("t", F.lit(0)).cast("long") - shift).alias("src"), (F.get("t", F.lit(1)).cast("long") - shift).alias("dst"), *([] if "pattern" in kinds else [F.get("t", F.lit(2)).cast("double").alias("weight")]))
    if symmetric := "symmetric" in kinds:
        rest = [c for c in edges.columns if c == "weight"]
        edges = edges.union(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))
    return Graph(spark.range(max(int(sizes[0]), int(sizes[1]))).toDF("id"), edges, symmetric)


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines that aren't blank, numbered from 0. The parts of one file come in order of place, so a running number orders its lines."""
    rows = spark.read.text(path).where("trim(value) <> ''").withColumn("__i", F.monotonically_increasing_id())
    return ranked(rows, [F.col("__i")], name)


def read_adjacency(spark: SparkSession, path: str, symmetric: bool = False) -> Graph:
    """Text adjacency in one file: a heading, n, m, n row starts, m targets and, in weighted files, m weights, one to a line."""
    lines = written(_numbered(spark, path, "line").select("line", F.trim("value").alias("v")))
    head = {r["line"]: r["v"] for r in lines.where("line < 3").collect()}
    n, m, weighted = int(head[1]), int(head[2]), head[0].startswith("Weighted")
    part = lambda a, k, name, kind: lines.where(f"line >= {a} and line < {a + k}").select((F.col("line") - a).alias("eid"), F.col("v").cast(kind).alias(name))
    return _from_slabs(part(3, n, "at", "long"), part(3 + n, m, "dst", "long"), n, m, part(3 + n + m, m, "weight", "double") if weighted else None, symmetric)


def read_friendster(spark: SparkSession, path: str) -> Graph:
    """Lines ``src:dst,dst,...``; ``private`` and ``notfound`` lists are empty. Compressed files are read as they are."""
    cut = F.split("value", ":")
    rows = spark.read.text(path).select(F.get(cut, F.lit(0)).cast("long").alias("src"), F.split(F.get(cut, F.lit(1)), ",").alias("d")).where("src is not null")
    edges = rows.select("src", F.explode("d").alias("d")).select("src", F.expr("try_cast(d as bigint)").alias("dst")).where("dst is not null")
    return Graph(rows.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges)


def write_edge_list(graph: Graph, path: str, sep: str = " ") -> None:
    graph.edges.write.csv(path, sep=sep)


# -- files of one piece: their parts are made by tasks, in order, and streamed through the driver, a partition at a time -----------


def _encoded(df: DataFrame, order: list[str], encode: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """``(part, nth, data)``: rows of ``df`` in order, encoded by the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for nth, pdf in enumerate(batches):
            yield pd.DataFrame({"part": [part], "nth": [nth], "data": [encode(pdf)]})

    rows = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return written(rows.mapInPandas(run, "part int, nth int, data binary"))


def _stream(spark: SparkSession, path: str, *pieces: bytes | DataFrame) -> None:
    """Write bytes and encoded parts, one after the other, to one file of any of Spark's file systems. What is in memory is a partition's bytes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for piece in pieces:
            if isinstance(piece, bytes):
                out.write(bytearray(piece))
                continue
            for row in piece.repartitionByRange("part", "nth").sortWithinPartitions("part", "nth").toLocalIterator():
                for at in range(0, len(row["data"]), CHUNK):
                    out.write(bytearray(row["data"][at : at + CHUNK]))
    finally:
        out.close()


def _numbers(df: DataFrame, order: list[str], column: str, kind: str) -> DataFrame:
    return _encoded(df, order, lambda pdf: pdf[column].to_numpy().astype(kind).tobytes())


def _slabs(graph: Graph) -> tuple[int, int, DataFrame, DataFrame]:
    """n, m, row starts (id, prefix) and edges of a graph whose vertices are 0 to n - 1; other ids are an error."""
    n, low, high = graph.vertices.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if n and (low != 0 or high != n - 1):
        raise ValueError("vertices aren't numbered from 0; see Graph.cleaned and Graph.relabelled")
    edges = written(graph.edges)
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    rows = graph.vertices.select("id").join(deg, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    return n, edges.count(), prefix_sums(rows, ["id"], "deg").select("id", "prefix"), edges


def write_binary(graph: Graph, path: str, version: int = 2, weights: str | None = None) -> None:
    """One file of version 2, or 3, which closes row starts with m. Targets are 32-bit, row starts 64-bit; ``weights`` gets the weights as 32-bit floats."""
    if version not in (2, 3):
        raise ValueError(f"version {version}")
    spark = graph.edges.sparkSession
    n, m, starts, edges = _slabs(graph)
    head = np.array([version, 1, n, m, 4, 8, 0, 0], "<u8").tobytes()
    end = np.array([m] if version == 3 else [], "<u8").tobytes()
    _stream(spark, path, head, _numbers(starts, ["id"], "prefix", "<u8"), end, _numbers(edges, ["src", "dst"], "dst", "<u4"))
    if weights:
        _stream(spark, weights, _numbers(edges, ["src", "dst"], "weight", "<f4"))


def write_config(graph: Graph, path: str) -> None:
    """Version 4: ``path.cfg`` beside its slabs ``path.index``, ``path.edges`` and, of weighted graphs, ``path.weights``."""
    spark, name = graph.edges.sparkSession, path.rsplit("/", 1)[-1]
    n, m, starts, edges = _slabs(graph)
    weighted = "weight" in edges.columns
    _stream(spark, f"{path}.index", _numbers(starts, ["id"], "prefix", "<u8"))
    _stream(spark, f"{path}.edges", _numbers(edges, ["src", "dst"], "dst", "<u4"))
    if weighted:
        _stream(spark, f"{path}.weights", _numbers(edges, ["src", "dst"], "weight", "<f4"))
    lines = {"version": 4, "num_vertices": n, "num_edges": m, "vid_size": 4, "eid_size": 8, "symmetric": str(graph.symmetric).lower(), "index": f'"{name}.index"', "edges": f'"{name}.edges"'} | ({"vertex_weights": f'"{name}.weights"'} if weighted else {})
    _stream(spark, f"{path}.cfg", "".join(f"{k} = {v};\n" for k, v in lines.items()).encode())


def write_adjacency(graph: Graph, path: str) -> None:
    """Text adjacency in one file: heading, n, m, row starts, targets and, of weighted graphs, weights."""
    n, m, starts, edges = _slabs(graph)
    weighted = "weight" in edges.columns
    lines = lambda df, order, column: _encoded(df, order, lambda pdf: "".join(f"{x}\n" for x in pdf[column]).encode())
    head = f"{'Weighted' if weighted else ''}AdjacencyGraph\n{n}\n{m}\n".encode()
    _stream(graph.edges.sparkSession, path, head, lines(starts, ["id"], "prefix"), lines(edges, ["src", "dst"], "dst"), *([lines(edges, ["src", "dst"], "weight")] if weighted else []))


def write_matrix_market(graph: Graph, path: str) -> None:
    """One file; symmetric graphs as their lower triangle with self-edges."""
    rows = written(graph.edges.where("src >= dst") if graph.symmetric else graph.edges)
    top, m = graph.vertices.agg(F.max("id")).first()[0], rows.count()
    size, weighted = 0 if top is None else top + 1, "weight" in rows.columns
    head = f"%%MatrixMarket matrix coordinate {'real' if weighted else 'pattern'} {'symmetric' if graph.symmetric else 'general'}\n{size} {size} {m}\n"

    def lines(pdf: pd.DataFrame) -> bytes:
        cols = [pdf["src"] + 1, pdf["dst"] + 1, *([pdf["weight"]] if weighted else [])]
        return "".join(" ".join(map(str, r)) + "\n" for r in zip(*cols, strict=True)).encode()

    _stream(graph.edges.sparkSession, path, head.encode(), _encoded(rows, ["src", "dst"], lines))


def read_grazelle(spark: SparkSession, path: str, pull: bool = False) -> Graph:
    n, m = np.frombuffer(_bytes(spark, path, 0, 16), "<u8").tolist()
    a, b = ("dst", "src") if pull else ("src", "dst")
    x = _slab(spark, path, 16, 2 * m, "<u8", "x").withColumn("pair", F.floor(F.col("eid") / 2))
    one = lambda k, name: F.max(F.when(F.col("eid") % 2 == k, F.col("x"))).alias(name)
    return Graph(spark.range(n).toDF("id"), x.groupBy("pair").agg(one(0, a), one(1, b)).select("src", "dst"))


def write_grazelle(graph: Graph, path: str, pull: bool = False) -> None:
    """One file of 64-bit numbers: vertices, edges, then a pair for each edge, by source or, for ``pull``, by destination first."""
    a, b = ("dst", "src") if pull else ("src", "dst")
    n, m = graph.vertices.count(), graph.edges.count()
    pairs = _encoded(graph.edges.select("src", "dst"), [a, b], lambda pdf: pdf[[a, b]].to_numpy("<u8").tobytes())
    _stream(graph.edges.sparkSession, path, np.array([n, m], "<u8").tobytes(), pairs)


def read_galois(spark: SparkSession, path: str, symmetric: bool = False) -> Graph:
    """A file of version 1: four 64-bit numbers (1, bytes of an edge's weight, n, m), row ends, 32-bit targets padded to a whole number of pairs, and 32-bit weights if there are any."""
    version, wide, n, m = np.frombuffer(_bytes(spark, path, 0, 32), "<u8").tolist()
    if version != 1 or wide not in (0, 4):
        raise ValueError(f"version {version}, weights of {wide} bytes")
    ends = _slab(spark, path, 32, n, "<u8", "at").select((F.col("eid") + 1).alias("eid"), "at")
    starts = ends.union(spark.createDataFrame([(0, 0)], "eid long, at long"))
    first = 32 + 8 * n
    weights = _slab(spark, path, first + 4 * (m + m % 2), m, "<f4", "weight") if wide else None
    return _from_slabs(starts, _slab(spark, path, first, m, "<u4", "dst"), n, m, weights, symmetric)


def read_property(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """``(id, value)``: one value a line, in order of id, in one file."""
    return _numbered(spark, path, "id").select("id", F.col("value").cast(kind).alias("value"))


def write_property(rows: DataFrame, path: str, value: str = "value") -> None:
    """One value a line in order of id, in one file."""
    encode = lambda pdf: "".join(f"{x}\n" for x in pdf[value].tolist()).encode()
    _stream(rows.sparkSession, path, _encoded(rows.select("id", value), ["id"], encode))
