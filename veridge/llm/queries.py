"""The registered queries of this subpackage, each its operator over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridge.llm import chat, language, license, matroska, mixing, pack, pii, simhash, suffix, topk
from veridge.runtime import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in pii.KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of base spans."""
    base = F.filter("spans", lambda x: ~x["added"])
    counts = [F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _of_kind(i: int):
    return lambda x: (x["kind"] == i) & ~x["added"]


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = matroska.load(matroska.store(table(spark, sf_dir, "documents")))
    size = F.length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.call_function("substring", F.col("payload"), size - 31, F.lit(32))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def media_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet table of the files that op6 reads back."""
    rows = matroska.packet_table(matroska.store(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "packet", "track", "nanoseconds", (F.col("end_byte") - F.col("first_byte")).alias("size"), "key", "cluster")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_simhash, op2_license, op3_chat, op4_pii, op5_topk, op6_matroska, op7_packing, op8_mixing, op9_suffix, op10_language, media_packets, pipeline)
    return {f.__name__: partial(_at, f) for f in each}


def _at(f: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(spark, sf_dir)


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{name}')" for name, s in license.SENTENCES.items())
    # Marks between sentences are doubled, so that each match has its own on both sides; of sentences that begin alike the longest is taken.
    each = "|".join(x.replace(" ", "[ ~]+") for x in sorted(license.SENTENCES.values(), key=lambda x: (-len(x), x)))
    like = lambda order: " AND ".join(["n > 0", f"regexp_matches(j, '{''.join(f',{s},(.*,)?' if k == 0 else f'{s},(.*,)?' for k, s in enumerate(order))}')"])
    cases = []
    for i, (name, order) in enumerate(license.RULES):
        longer = [before for other, before in license.RULES[:i] if before[: len(order)] == order and other != name]
        cases.append(f"CASE WHEN {like(order)}{''.join(f' AND NOT ({like(b)})' for b in longer)} THEN '{name}' END")
    return f"""
WITH known(s, name) AS (VALUES {known}),
m AS (SELECT map(list(s), list(name)) AS k FROM known),
low AS (SELECT doc_id, translate(replace(lower(coalesce(text, '')), chr(13) || chr(10), chr(10)), '|~', '  ') AS t FROM documents),
ended AS (SELECT doc_id, regexp_replace(t, '[.!?:;]*[.!?][.!?:;]*[\\x20\\x09-\\x0D]+|[\\x0A\\x0D](?:[^a-z0-9\\x0A\\x0D]*[\\x0A\\x0D])+', '|', 'g') AS t FROM low),
words AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[:;][\\x20\\x09-\\x0D]+|[\\x0A\\x0D]+', '~', 'g'), '[^a-z0-9|~]+', ' ', 'g') AS t FROM ended),
parts AS (
  SELECT doc_id, list_transform(regexp_extract_all('|' || replace(replace(t, '|', '||'), '~', '~~') || '|', '[|~] ?({each}) ?[|~]', 1),
    lambda x: k[regexp_replace(x, '[ ~]+', ' ', 'g')]) AS ids
  FROM words, m),
j AS (SELECT doc_id, len(ids) AS n, array_to_string(ids, ',') AS s, ',' || array_to_string(ids, ',') || ',' AS j FROM parts),
h AS (SELECT *, [{", ".join(cases)}] AS hits FROM j)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, coalesce(s, '') AS sentences,
  coalesce(array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i), ','), '') AS licenses
FROM h"""


_CHAT_SQL = """
WITH own AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
sides AS (SELECT DISTINCT conv_id, speaker AS perspective FROM own WHERE speaker <> 'system'),
shown AS (
  SELECT o.conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS as_role
  FROM own o JOIN sides s ON o.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (
  SELECT *, '<|' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || replace(replace(speaker, '<|', '<\\|'), '|>', '|\\>') ELSE '' END || '|>' || chr(10) AS head
  FROM shown),
r AS (SELECT *, head || replace(replace(text, '<|', '<\\|'), '|>', '|\\>') || '<|end|>' || chr(10) AS rendered FROM h)
SELECT conv_id, perspective, turn, speaker, as_role, rendered, CAST(as_role = 'assistant' AS INTEGER) AS mask,
  CASE WHEN as_role = 'assistant' THEN length(head) ELSE 0 END AS learn_from,
  CASE WHEN as_role = 'assistant' THEN length(rendered) - 1 ELSE 0 END AS learn_to, CAST(length(rendered) AS BIGINT) AS n_chars
FROM r"""

_PACKETS_SQL = """
WITH d AS (SELECT doc_id, greatest(1, (octet_length(encode(coalesce(text, ''))) + 575) // 576) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(n)) AS packet FROM d)
SELECT doc_id, packet, CAST(1 AS BIGINT) AS track, CAST(packet * 72000000 AS BIGINT) AS nanoseconds, CAST(576 AS BIGINT) AS size, true AS key, packet // 256 AS cluster
FROM p"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license": _license_sql(), "op3_chat": _CHAT_SQL, "op5_topk": _TOPK_SQL, "media_packets": _PACKETS_SQL}
