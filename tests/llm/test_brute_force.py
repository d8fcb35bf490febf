"""Queries whose rows SQL can't give, and every stage of the pipeline, against plain versions of their own."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_fingerprint, brute_redaction, brute_repeats, brute_spans

from veridge.llm import language, mixing, pii, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with few enough labelled documents that each is a landmark: copies, near copies, personal data, no letters, nulls."""
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150)
    first = [r["text"] for r in own.orderBy("doc_id").limit(4).collect()]
    odd = [(90_001, first[0]), (90_002, f"{first[1]} more"), (90_003, None), (90_004, "12 34 ..."), (90_005, "write to me@x.org or 10.0.0.7, " + first[2]), (90_006, "é " + first[3]), (90_006, "other words under an id that is taken")]
    path = str(tmp_path_factory.mktemp("few"))
    own.unionByName(spark.createDataFrame([(i, t, None, "src0", len(t or "")) for i, t in odd], own.schema)).write.parquet(f"{path}/documents.parquet")
    return path


def rows_of(spark, folder):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def grams(text):
    """Hashed n-grams of one to three letters, one by one."""
    cp, out = [ord(c) for c in text.lower()], set()
    for i in range(len(cp)):
        h = 0
        for n, c in enumerate(cp[i : i + language.MAX_N], 1):
            h = ((h ^ c) * 0x9E3779B1 + n) % (1 << 32)
            out.add(((h ^ (h >> 15)) >> 3) % language.DIM)
    return out


def brute_languages(rows):
    """(language, score) of each row by kernel ridge regression in its dual form, without landmarks."""
    teach = [r for r in rows if r["lang"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and re.search(r"[^\W\d_]", r["text"] or "")]
    names, sets = sorted({r["lang"] for r in teach}), [grams(r["text"]) for r in teach]
    assert len(teach) <= language.LANDMARKS
    near = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    label = [r["lang"] for r in teach]
    k = np.array([[near(a, b) for b in sets] for a in sets])
    weak = np.diag([language.RIDGE / len(names) * label.count(v) for v in label])
    alpha = np.linalg.solve(k + weak, np.array([[1.0 if v == n else -1.0 for n in names] for v in label]))
    out = []
    for r in rows:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            out.append(("und", 0.0))
            continue
        g = grams(r["text"])
        s = np.clip((np.array([near(g, b) for b in sets]) @ alpha + 1) / 2, 0, 1)
        out.append((names[int(s.argmax())], float(s.max())))
    return out


def brute_rates(rows):
    """Each row's (size, source_size, target, rate): levels and duals by bisection."""
    size = [len(WORDS.findall(r["text"] or "")) for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(z for r, z in zip(rows, size, strict=True) if r["source"] == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}

    def root(f, lo, hi):
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        return (lo + hi) / 2

    level = root(lambda v: sum(min(2 * total[n], v * weight[n]) for n in names) - 1.5 * sum(size), 0, 1e9)
    target = {n: min(2 * total[n], level * weight[n]) for n in names}
    tilt = {}
    for n in names:
        own = np.array([z for r, z in zip(rows, size, strict=True) if r["source"] == n], float)
        tilt[n] = root(lambda t, own=own, n=n: (np.minimum(2, np.exp(np.minimum(t * own, 50))) * own).sum() - target[n], -50, 50)
    rate = [2.0 if target[r["source"]] >= 2 * total[r["source"]] - 1e-9 else min(2.0, float(np.exp(min(50, tilt[r["source"]] * z)))) for r, z in zip(rows, size, strict=True)]
    return [(z, total[r["source"]], target[r["source"]], v) for r, z, v in zip(rows, size, rate, strict=True)]


def check_mix(spark, rows, decided):
    """``decided`` maps (id, text) to (taken whole, words beyond): rates round down or up, up for the lowest places only, and meet the targets."""
    own = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    measured = own.select("text", *mixing._measures(F.col("text"), F.col("doc_id"), F.col("source")))
    draw = {(r["doc_id"], r["text"]): r["draw"] for r in mixing._drawn(measured).collect()}
    by = {}
    for r, (z, _, target, rate) in zip(rows, brute_rates(rows), strict=True):
        copies, part = decided[r["doc_id"], r["text"]]
        if abs(rate - round(rate)) < 1e-6:
            rate = round(rate)
        whole = int(rate)
        assert copies in ((0,) if z == 0 else (whole, whole + 1)) and copies * z + part <= 2 * z
        by.setdefault((r["source"], target), []).append((copies > whole, draw[r["doc_id"], r["text"]] - (rate - whole) + 1, part, copies * z + part, z > 0 and whole < 2))
    for (_, target), got in by.items():
        assert abs(sum(taken for *_, taken, _ in got) - target) <= 1 and sum(part > 0 for _, _, part, *_ in got) <= 1
        up, down = [v for u, v, *_ in got if u], [v for u, v, *_, free in got if free and not u]
        assert not up or not down or max(up) <= min(down) + 2 / mixing.BINS**2


def test_mixing_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = rows_of(spark, folder)
    got = {r["doc_id"]: r for r in queries.op8_mixing(spark, folder).collect()}
    assert len(got) == len(rows)
    for r, (z, source, target, _) in zip(rows, brute_rates(rows), strict=True):
        g = got[r["doc_id"]]
        assert (g["size"], g["source_size"]) == (z, source) and g["target"] == pytest.approx(target, rel=1e-9)
    check_mix(spark, rows, {(r["doc_id"], r["text"]): (got[r["doc_id"]]["copies"], got[r["doc_id"]]["taken"] - got[r["doc_id"]]["copies"] * got[r["doc_id"]]["size"]) for r in rows})


def test_language_query(spark, folder):
    rows = rows_of(spark, folder)
    want = sorted((r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2, v, s) for r, (v, s) in zip(rows, brute_languages(rows), strict=True))
    got = sorted(map(tuple, queries.op10_language(spark, folder).select("doc_id", "held_out", "lang_pred", "score").collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-3)


def test_other_queries(spark, folder):
    """Columns of the queries on SimHash, personal data and repeated strings."""
    rows = rows_of(spark, folder)
    by_text = {r["text"]: brute_fingerprint(r["text"]) for r in rows}
    ids = sorted(r["doc_id"] for r in rows)
    group = {f: f for f in by_text.values()}
    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {f: new if g == old else g for f, g in group.items()}
    least = {}
    for r in rows:
        g = group[by_text[r["text"]]]
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted((r["doc_id"], f"{by_text[r['text']]:016x}", least[group[by_text[r["text"]]]]) for r in rows)
    assert want == sorted(map(tuple, queries.op1_simhash(spark, folder).collect()))
    once = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id <> 90006")
    once.write.mode("overwrite").parquet(f"{folder}/once/documents.parquet")
    rows = sorted((r for r in rows if r["doc_id"] != 90006), key=lambda r: r["doc_id"])
    gone = brute_repeats([(r["doc_id"], r["text"]) for r in rows])
    got = {r["doc_id"]: r for r in queries.op9_suffix(spark, f"{folder}/once").collect()}
    assert {i: (r["n_removed"], r["n_bytes"] - r["n_removed"]) for i, r in got.items()} == {i: (n, len(kept)) for i, (n, kept) in gone.items()}
    spans = {r["doc_id"]: r for r in queries.op4_pii(spark, f"{folder}/once").collect()}
    for r in rows:
        base = [s for s in brute_spans(r["text"]).split(",") if s]
        assert [spans[r["doc_id"]][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(f"{k}:") for s in base) for k in pii.KINDS]
        assert set(base) <= set(spans[r["doc_id"]]["spans"].split(","))
    assert len(got) == len(spans) == len(ids) - 2


def test_pipeline_stages(spark, folder):
    """What each stage keeps, changes and repeats, on all that the one before it kept."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in p.STAGES:
        tables.append(p.written(stage(spark, tables[-1], folder)))
    raw, known, single, clean, mixed = ([r.asDict() for r in t.collect()] for t in tables[:5])
    key = lambda r: (r["doc_id"], r["text"] or "")
    keys = lambda rows: sorted(map(key, rows))
    assert all(t.columns == tables[0].columns for t in tables[:5])

    judged = list(zip(raw, brute_languages(raw), strict=True))
    assert all(abs(s - language.LEAST_SCORE) > 5e-3 for _, (_, s) in judged)
    assert keys(known) == keys(r for r, (_, s) in judged if s >= language.LEAST_SCORE)

    group = brute_components([key(r) for r in known])
    least = {g: min(r["doc_id"] for r, h in zip(known, group, strict=True) if h == g) for g in group}
    assert sorted(r["doc_id"] for r in single) == sorted(least.values()) and set(keys(single)) <= set(keys(known)) and len(single) < len(known)

    spans = {(r["doc_id"], r["text"]): [(x["s"], x["e"], x["kind"]) for x in r["spans"]] for r in pii.find(tables[2]).join(tables[2], "doc_id").select("doc_id", "text", "spans").collect()}
    assert all({s for s in brute_spans(t).split(",") if s} <= {f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in found} for (_, t), found in spans.items())
    assert keys(clean) == keys({**r, "text": brute_redaction(r["text"], spans[key(r)])} for r in single) != keys(single)

    of = {r["doc_id"]: r for r in clean}
    decided = {key(r): [0, 0] for r in clean}
    for r in mixed:
        text = of[r["doc_id"]]["text"]
        if r["text"] == text:
            decided[r["doc_id"], text][0] += 1
        else:
            words = WORDS.findall(r["text"])
            assert text.startswith(r["text"]) and words == WORDS.findall(text)[: len(words)] and not decided[r["doc_id"], text][1]
            decided[r["doc_id"], text][1] = len(words)
    check_mix(spark, clean, decided)

    tok = Tokenizer.from_file(queries.vocabulary())
    want, got, sequences = [], {}, {}
    for r in mixed:
        want.append((r["doc_id"], tuple([*tok.encode(r["text"], add_special_tokens=False).ids, 2])))
    for packed in (tables[5], p.run(spark, folder)):
        got, sequences = {}, {}
        for r in packed.collect():
            got.setdefault(r["doc_id"], []).append((r["start"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist()), r["doc_tokens"]))
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for i, ids in want:  # every copy's ids, whole or in pieces that follow each other
            at = 0
            while at < len(ids):
                piece = max((x for x in got[i] if x[0] == at and x[2] == len(ids) and ids[at : at + len(x[1])] == x[1]), key=lambda x: len(x[1]))
                got[i].remove(piece)
                at += len(piece[1])
        assert not any(got.values())
        for parts in sequences.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
