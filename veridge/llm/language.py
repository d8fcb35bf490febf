"""Language identification with a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams of 1 to MAX_N code points; rows of a batch; ridge.
DIM, MAX_N, BATCH, RIDGE = 8192, 3, 128, 1e-2
#: The fit takes at most this many labelled rows, split evenly over the languages, though one of each, and so many landmarks of them.
TRAIN_ROWS, LANDMARKS = 1600, 128
UNKNOWN = "und"
LEAST_SCORE = 0.25
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 20


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams of the blended spectrum occur in the lower-cased text, as booleans."""
    out = np.zeros(DIM, dtype=bool)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(cp), _CHUNK):
        x = cp[at : at + _CHUNK + MAX_N - 1]
        h = np.zeros(len(x), dtype=np.uint32)
        for n in range(1, MAX_N + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
            out[(h ^ (h >> np.uint32(15))) >> np.uint32(3) & np.uint32(DIM - 1)] = True
    return out


@dataclass
class Model:
    """``langs``; landmarks, scaled, as columns; and the weights that map kernel values to a score for each language."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        k = (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return np.clip((k @ self.weights + 1) / 2, 0, 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(langs: list[str], rows: np.ndarray) -> Model:
    """Fit to presence rows with their languages; landmarks are the first rows of each language in turn."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0), np.float32))
    y = np.array([names.index(v) for v in langs])
    turn = np.zeros(len(y), int)
    for c in range(len(names)):
        turn[y == c] = np.arange((y == c).sum())
    x = _scaled(rows.astype(np.float64))
    marks = x[np.lexsort((y, turn))[:LANDMARKS]]
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    phi = x @ marks.T @ root
    share = 1 / np.bincount(y)[y]
    a = (phi * share[:, None]).T @ phi + RIDGE / max(len(names), 1) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, (phi * share[:, None]).T @ np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0))
    return Model(names, marks.T.astype(np.float32), (root @ w).astype(np.float32))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fit to a sample of ``docs`` that are labelled and not held out: in each language, rows whose hashed id comes first.

    What comes to the driver is a count for each language and, of ``rows`` rows or one for each language if those are more, about twice as many presence rows of ``DIM`` bits.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and id is not null").where(~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], np.zeros((0, DIM), bool))
    each = max(1, rows // len(counts))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "id"), 1).cast("double") / float(1 << 63)
    rate = F.create_map(*(F.lit(v) for c, n in counts.items() for v in (c, min(1.0, (each + 3 * each**0.5) / n))))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "draw": pdf["draw"], "bits": [np.packbits(presence(t)).tobytes() for t in pdf["text"]]})

    sample = own.withColumn("draw", draw).where(F.col("draw") < rate[F.col("lang")]).where(F.rlike("text", F.lit(r"\p{L}")))
    got = sorted((r["draw"], r["lang"], bytes(r["bits"])) for r in sample.select("lang", "draw", "text").mapInPandas(bits, "lang string, draw double, bits binary").toLocalIterator())
    taken: dict[str, int] = {}
    keep = [r for r in got if (taken.update({r[1]: taken.get(r[1], 0) + 1}) or taken[r[1]] <= each)]
    return fit([r[1] for r in keep], np.array([np.unpackbits(np.frombuffer(r[2], np.uint8)) for r in keep], dtype=bool).reshape(-1, DIM))


def _predictor(model: Model):
    def predict(texts: list) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.langs else []
        for k in range(0, len(at), BATCH):
            part = at[k : k + BATCH]
            s = model.scores(np.array([presence(texts[i]) for i in part]))
            for i, j, v in zip(part, s.argmax(1), s.max(1), strict=True):
                langs[i], scores[i] = model.langs[j], round(float(v), 6)
        return langs, scores

    return predict


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``.

    Only the text goes into a prediction, all of it. A text that is null, empty or without a letter is ``und`` with score 0, as is every text if no row has a label. Rows without an id aren't held out and teach nothing. Equal texts get equal predictions; of languages with equal scores the first in order wins. Other columns aren't read.
    """
    predict = _predictor(model or train(docs, text, lang, id_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs, scores = predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": langs, "score": scores})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return own.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those that are ``und`` or score under ``least``; all columns stay as they are. With no labels at all, only texts without letters go."""
    model = train(docs, text, lang, id_col)
    predict = _predictor(model)

    score = F.pandas_udf(lambda t: pd.Series(predict(t.tolist())[1] if model.langs else [float(bool(x and _LETTER.search(x))) for x in t], dtype="float64"), "double")
    return docs.where(score(F.col(text).cast("string")) >= least)
