"""The training-data operators against brute force on small fixtures and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veridge.llm import chat, language, license, matroska, mixing, pack, pii, queries, shingles, simhash, suffix, topk

ODD = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, " \n\t"), (6, "A b C d e f"), (6, "zz"), (None, "x y"), (None, None), (7, "été 😀 " * 3000), (8, "1" * 5000), (9, "w " * 20000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    rows = [(i, t, "en" if i != 4 else None, f"s{k % 3}" if k % 4 else None, k, "x") for k, (i, t) in enumerate([*ODD, ODD[0]])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, row string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(odd, docs, none):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        got = simhash.near_duplicates(df).collect()
        fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
        assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in got) == sorted((i or -1, f"{f:016x}") for i, f in fps)
        group = {f: {f} for _, f in fps}
        for a in list(group):
            for b in list(group):
                if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                    both = group[a] | group[b]
                    group.update(dict.fromkeys(both, both))
        least = {f: min((i for i, g in fps if g in group[f] and i is not None), default=None) for _, f in fps}
        assert all(r["component_id"] == least[int(r["fingerprint"], 16)] for r in got)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 6)").count() == 2


def test_simhash_links(spark):
    """A dense group, chains, and pairs of 4 and 5 bits among random fingerprints: components are those of all pairs, links few."""
    rng = np.random.default_rng(8)
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    flip = lambda x, n: x ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False))
    base, fps = int(rng.integers(1 << 63)), set()
    dense = {base, *(flip(base, int(k)) for k in rng.integers(1, 4, 400))}
    for _ in range(200):
        x = int(rng.integers(1 << 63))
        fps |= {x, flip(x, 4), flip(x, 5)}
    for _ in range(20):
        x = int(rng.integers(1 << 63))
        for _ in range(6):
            fps.add(x := flip(x, 4))
    fps = sorted(fps | dense | {0, (1 << 64) - 1, 15})
    group = {x: x for x in fps}
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4 and group[x] != group[y]:
                old, new = group[x], group[y]
                group = {k: new if v == old else v for k, v in group.items()}
    links = simhash.link_fingerprints(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    assert all((int(r["src"]) ^ int(r["dst"])) & ((1 << 64) - 1) and (((int(r["src"]) ^ int(r["dst"])) & ((1 << 64) - 1)).bit_count() <= 4) for r in links)
    got = {signed(x): signed(x) for x in fps}
    for r in links:
        old, new = got[r["src"]], got[r["dst"]]
        if old != new:
            got = {k: new if v == old else v for k, v in got.items()}
    parts = lambda g: {frozenset(k for k in g if g[k] == v) for v in set(g.values())}
    assert parts(got) == {frozenset(map(signed, s)) for s in parts(group)}
    inside = {signed(x) for x in dense}
    assert sum(r["src"] in inside for r in links) <= 15 * len(dense)


def test_simhash_repeated_ids(spark):
    """Texts under one id are judged apart, in either order."""
    rows = [(1, "a b c d e f"), (6, "a b c d e f"), (6, "zz"), (7, "yy"), (7, "a b c d e f")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f"), (6, "zz"), (7, "yy")]


def brute_components(rows, least=0.8):
    """Rows (id, text) to the index of their component's row that stays: links are exact five-word similarities."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 10 * least * len(sets[i] | sets[j]) - 1e-6 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_pipeline_near_duplicates(spark, docs, odd, none):
    """Pairs from 0.7 to 1, a group of copies of one text with an edit each, and ids with several texts, against all pairs."""
    import corpus_pipeline as p

    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    rows = []
    for n in range(60):
        base = word(100 + 5 * n)
        other = list(base)
        for at in rng.integers(0, len(base), 1 + len(base) * (n % 6) // 200):
            other[at] = "new"
        rows += [(1000 + 2 * n, " ".join(base)), (1001 + 2 * n, " ".join(other).upper())]
    base = word(80)
    for n in range(40):
        rows.append((3000 + n, " ".join([*base[: 2 * n], "odd", *base[2 * n + 1 :]])))
    base = word(150)
    for n in range(150):  # a dense group whose members are near only some others
        other = list(base)
        for at in rng.integers(0, len(base), n % 9):
            other[at] = f"n{rng.integers(1000)}"
        rows.append((5000 + n, " ".join(other)))
    rows += [(1000, rows[2][1]), (1000, "a text of its own"), (1003, "one more")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (plain, docs, odd):
        own = [(r["doc_id"], r["text"]) for r in df.collect()]
        known = [r for r in own if r[0] is not None]
        group = brute_components(known)
        best = {}
        for g, (i, _) in zip(group, known, strict=True):
            best[g] = min(best.get(g, i), i)
        kept = p.drop_near_duplicates(spark, df, "")
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert kept.columns == df.columns and sorted(i for i, _ in got if i is not None) == sorted(best.values())
        of = {}
        for g, r in zip(group, known, strict=True):
            of[r] = g
        assert len({of[r] for r in got if r[0] is not None}) == len(best) and sum(i is None for i, _ in got) == sum(i is None for i, _ in own)
    assert p.drop_near_duplicates(spark, none, "").count() == 0


def test_wide_simhash(spark, monkeypatch):
    """The near-duplicate stage's SimHash: fingerprints and groups against plain versions, and pairs at 0.8 that it proposes."""
    rng = np.random.default_rng(5)
    bits = lambda x: [int(v) >> b & 1 for v in x for b in range(64)]
    for text in (None, "", "one two", "a b c d e f g", " ".join(f"w{x}" for x in rng.integers(0, 90, 700))):
        h = [int(x) for x in shingles.shingles(text)]
        got = simhash.wide_fingerprint(np.array(h, np.uint64), 384)
        assert len(got) == 6 and int(got[0]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        keys = simhash.block_keys(got, 38, 10)
        assert keys.tolist() == [(t << 10) + sum(v << i for i, v in enumerate(bits(got)[10 * t : 10 * t + 10])) for t in range(38)]
    assert simhash.wide_blocks(0) == simhash.wide_blocks(1 << 20) == (48, 8) and simhash.wide_blocks(1 << 24)[1] == 12

    prints = rng.integers(0, 1 << 62, (3, 12), dtype=np.uint64).repeat(40, 1)
    for n in range(prints.shape[1]):
        for b in rng.integers(0, 192, n % 40):
            prints[b // 64, n] ^= np.uint64(1 << int(b % 64))
    prints = prints[:, rng.permutation(prints.shape[1])]
    far = np.bitwise_count(prints[:, :, None] ^ prints[:, None, :]).sum(0)
    for limit in (0, 10, 25, 60):
        want = (far <= limit).astype(int)
        while not (want == (more := (want @ want > 0).astype(int))).all():
            want = more
        for tile, references in ((7, 16), (64, 1), (256, 4)):
            monkeypatch.setattr(simhash, "TILE", tile)
            monkeypatch.setattr(simhash, "REFERENCES", references)
            label = simhash.linked(prints, limit)
            assert ((label[:, None] == label) == want.astype(bool)).all() and (label[label] == label).all()

    rows = []  # sets of a and b shingles with c in common
    for n, (a, b, c) in enumerate([(4, 5, 4), (9, 9, 8), (5, 6, 5), (90, 90, 80), (80, 100, 80), (1, 1, 1)] * 60):
        x = rng.integers(0, 1 << 63, a + b - c, dtype=np.uint64) * np.uint64(2) + np.uint64(n % 2)
        for i, own in enumerate((x[:a], x[a - c :])):
            p = simhash.wide_fingerprint(own, 384)
            rows.append((2 * n + i, *map(int, p[:3].view(np.int64)), simhash.block_keys(p, 48, 8).tolist()))
    table = spark.createDataFrame(rows, "node long, w0 long, w1 long, w2 long, keys array<int>")
    by = {}
    for r in simhash.wide_groups(table, len(rows), 48).collect():
        by.setdefault(r["key"], set()).add((r["node"], r["head"]))
    assert all(len({h for _, h in g}) == 1 and {h for _, h in g} <= {i for i, _ in g} and len(g) > 1 for g in by.values())
    together = {frozenset(i for i, _ in g) for g in by.values()}
    assert all(any({2 * n, 2 * n + 1} <= g for g in together) for n in range(len(rows) // 2))


def most_joined(spark, since):
    """The rows that the largest join of the queries from number ``since`` on made, and the number of the next query."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for i in (runs.apply(k).executionId() for k in range(runs.size())):
        if i < since:
            continue
        last, nodes, values = max(last, i + 1), store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "").split()[-1]))
    return most, last


def test_near_duplicate_blocks(spark, monkeypatch):
    """A text's set goes to few tasks, however many buckets it shares with a large group; groups of several blocks, as a whole and bucket by bucket, join what all pairs join."""
    rng = np.random.default_rng(4)
    base, rows = [f"w{x}" for x in range(130)], []
    for n in range(300):  # some of a dense component, some linked in small ones, some near no other
        other = list(base)
        for at in rng.integers(0, len(base), n % 3 if n < 100 else n % 16):
            other[at] = f"n{rng.integers(1000)}"
        rows.append((n, " ".join(other)))
    rows = list({t: (i, t) for i, t in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group = brute_components(rows)
    want = {frozenset(i for (i, _), g in zip(rows, group, strict=True) if g == k) for k in group}
    assert max(map(len, want)) > 50 and len(want) > 20

    def parts():
        of = {}
        for r in shingles.near_duplicates(docs).collect():
            of.setdefault(r["comp"], set()).add(r["doc_id"])
        return {frozenset(x) for x in of.values()}

    _, since = most_joined(spark, 0)
    assert parts() == want
    most, since = most_joined(spark, since)
    assert len(rows) <= most <= 2 * len(rows)
    for block, large in ((40, 1 << 15), (7, 1 << 15), (20, 20)):
        monkeypatch.setattr(shingles, "BLOCK", block)
        monkeypatch.setattr(shingles, "LARGE", large)
        assert parts() == want

    sets = [shingles.shingles(t) for _, t in rows]
    comps, sides = np.arange(len(sets)), rng.integers(0, 2, len(sets))
    for cross in (False, True):
        for tile in (9, 1 << 10):
            monkeypatch.setattr(shingles, "_TILE", tile)
            label = np.arange(len(sets))
            for x, y in shingles._tiled(comps, sides, sets, cross, 0.8):
                assert not cross or sides[x] != sides[y]
                label[label == label[x]] = label[y]
            found = {tuple(np.flatnonzero(label == k)) for k in label}
            assert tile == 9 or found == whole
            whole = found


def test_shingle_blocks(monkeypatch):
    """Blocks of sets join what all pairs join, within and across; chunks of shingles change nothing."""
    rng = np.random.default_rng(2)
    sets, base = [], rng.integers(0, 1 << 40, 200)
    for n in range(60):
        x = base.copy()
        at = rng.integers(0, 200, n % 40)
        x[at] = rng.integers(0, 1 << 40, len(at))
        sets.append(np.unique(x))
    sets += [np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([5])]
    comps, sides = np.arange(len(sets)) // 2, rng.integers(0, 2, len(sets))

    def parts(pairs):
        g = list(range(len(sets)))
        for x, y in pairs:
            g = [g[y] if v == g[x] else v for v in g]
        return {frozenset(i for i, v in enumerate(g) if v == k) for k in g}

    for cross in (False, True):
        want = [(x, y) for x in range(len(sets)) for y in range(x) if comps[x] != comps[y] and (not cross or sides[x] != sides[y]) and len(set(sets[x]) & set(sets[y])) >= 0.8 * len(set(sets[x]) | set(sets[y])) - 1e-9]
        for columns in (7, 1 << 13):
            monkeypatch.setattr(shingles, "_COLUMNS", columns)
            got = shingles._close(comps, sides, sets, cross, 0.8)
            assert set(got) <= set(want) and parts(got) == parts(want)


def test_license(spark, odd, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    parts = mit.split("\n\n")
    d = spark.createDataFrame([(1, mit), (2, "\n".join(reversed(parts))), (3, "so. RELEASED under the MIT License!!\nx"), (4, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    assert {r["doc_id"]: list(r["licenses"]) for r in license.scan(d).collect()} == {1: ["MIT"], 2: [], 3: ["MIT"], 4: ["Apache-2.0"]}
    assert license.scan(odd).where("size(licenses) > 0").count() == 0 and license.scan(odd).count() == 13 and license.scan(none).count() == 0
    assert all(re.search(license.cue(license.SENTENCES), s) for s in license.SENTENCES.values())
    own = license.scan(spark.createDataFrame([(1, "One. Take what you\nlike. Two"), (2, "TAKE what, you like"), (3, "take what you")], "doc_id long, text string"), sentences={"t": "take what you like"}, rules=(("Own", ("t",)),))
    assert {r["doc_id"]: list(r["licenses"]) for r in own.collect()} == {1: ["Own"], 2: ["Own"], 3: []}


def test_license_texts(spark):
    """Heads of licenses as they come, wrapped, in comments and as tags."""
    texts = {
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL",
        "Apache-2.0": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.",
        "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation",
        "LGPL-2.1-or-later": "/* This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n *\n * This library is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n */",
        "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this file,",
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free",
        "BSD-3-Clause": "# SPDX-License-Identifier: BSD-3-Clause\n\nimport os",
    }
    rows = list(enumerate(texts.values()))
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: list(r["licenses"]) for r in got} == {i: [name] for i, name in enumerate(texts)}


def test_license_wrapped(spark):
    """Texts wrapped at 70 columns, plain and as comments."""
    import textwrap

    s = license.SENTENCES
    mit = [s["mit-grant"] + ":", s["mit-condition"] + ".", s["as-is"].replace("as is", '"AS IS"') + ". In no event."]
    gpl = ["Copyright (C) 2020 X", s["gpl-free"].replace("software you", "software: you") + ".", s["gpl-hope"] + "."]
    bsd = [s["bsd-redistribute"] + ":", "1. " + s["bsd-source"] + ".", "2. " + s["bsd-binary"] + "."]
    apache = ["Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in\ncompliance with the License."]
    rows, want = [], {}
    for name, parts in (("MIT", mit), ("GPL-3.0-or-later", gpl), ("BSD-2-Clause", bsd), ("Apache-2.0", apache)):
        lines = "\n\n".join(p if "\n" in p else textwrap.fill(p, 70) for p in parts).split("\n")
        for end, mark in (("\n", ""), ("\r\n", ""), ("\n", "# "), ("\n", " * "), ("\n", "// "), ("\n", ";; ")):
            want[len(rows)] = [name]
            rows.append((len(rows), end.join(mark + x for x in ["Some title", *lines, "and code"])))
    rows.append((len(rows), s["mit-grant"].replace("copy of", "copy. of")))
    want[len(rows) - 1] = []
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: list(r["licenses"]) for r in got} == want


def test_license_sql(spark, tmp_path):
    """The query and its SQL on sentences, pieces of them and other words in any order, with any marks between."""
    import duckdb

    rng = np.random.default_rng(6)
    known, marks = list(license.SENTENCES.values()), [" ", "\n", "\r\n", "\r", ". ", ": ", ";\n", ".", " | ", "~", "\n\n", "\r\n\r\n", "\n# ", "\n *\n * ", "?! ", ".:\t", "...", "", "\u3002", "\n\u00e9\n"]
    rows = [(0, None), (1, ""), (2, "\r\n")]
    for i in range(3, 3000):
        out = []
        for _ in range(rng.integers(1, 7)):
            w = known[rng.integers(len(known))].split() if rng.random() < 0.8 else ["other", "words"]
            if rng.random() < 0.2:
                w = w[: rng.integers(1, len(w) + 1)]
            if rng.random() < 0.5:
                w[rng.integers(len(w))] += marks[rng.integers(len(marks))].strip(" ") or ","
            out.append(" ".join(w).upper() if rng.random() < 0.3 else (" " if rng.random() < 0.5 else marks[rng.integers(len(marks))] or " ").join(w))
            out.append(marks[rng.integers(len(marks))])
        rows.append((i, "".join(out)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, queries.op2_license(spark, str(tmp_path)).select("doc_id", "n_sentences", "sentences", "licenses").collect()))
    want = sorted(db.sql(f"SELECT doc_id, n_sentences, sentences, licenses FROM ({queries.oracle_sql()['op2_license']})").fetchall())
    assert got == want
    assert len({r[3] for r in got}) > 50


def test_chat(spark, monkeypatch):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (2, 0, None, None), (2, 0, None, None), (None, 0, "", "x"), (3, 0, "system", "alone"), (4, 0, "a|>b", "so <|end|> he\U0001f600")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "conv_id long, turn long, role string, text string, salt int, head string")
    kept = []
    for large, shares in ((10_000, 1_000), (1, 10)):
        monkeypatch.setattr(chat, "LARGE", large)
        monkeypatch.setattr(chat, "SHARES", shares)
        got = chat.rotate(df).collect()
        side = lambda c, p: [r["rendered"] for r in sorted((r for r in got if r["conv_id"] == c and r["perspective"] == p), key=lambda r: r["turn"])]
        assert side(1, "user") == ["<|system|>\nbe<|end|>\n", "<|assistant|>\nhi<|end|>\n", "<|user name=assistant|>\nyo<|end|>\n"]
        assert side(4, "a|>b") == ["<|assistant|>\nso <\\|end|\\> he\U0001f600<|end|>\n"]
        assert len(got) == 6 + 2 + 1 + 1 and all(r["mask"] == (r["speaker"] == r["perspective"]) for r in got)
        assert all(r["rendered"][r["learn_from"] : r["learn_to"]] == (r["rendered"].split("\n")[1] if r["mask"] else "") for r in got)
        kept.append(sorted(map(str, got)))
    assert kept[0] == kept[1] and chat.rotate(df.limit(0)).count() == 0


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def brute_redaction(text, spans):
    """Spans (s, e, kind) replaced from left to right; one that begins inside the last is swallowed."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{pii.KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_pii(spark, odd, docs, none):
    hard = ["a@b.com_x@c.org", "é😀 me@x.de", "1.2.3.4.5.6.7.8 300.1.1.1 000255.1.1.1 1256.1.1.1", "4465758382889437 4465758382889437", "+1 (743) 555-3824. ", "4465 7583 8288 9437", "@@a@b.c.d-e.f@g.hh", "1.2.3.4@x.org +49 30 1234 5678", "é😀" * 700 + " me@x.de " + "日本" * 2000 + "1.2.3.4" + "x" * 4096, " ".join(f"u{i}@h{i}.com" for i in range(700))]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra).union(odd.select(F.col("doc_id") + 2 * 10**6, "text"))
    rows = df.where("doc_id != 2000006").collect()
    want = sorted((r["doc_id"] or -1, hashlib.sha256(brute_spans(r["text"]).encode()).hexdigest()) for r in rows)
    base = F.filter("spans", lambda x: ~x["added"])
    got = pii.find(df).withColumn("h", F.sha2(queries._listed(base), 256)).where("doc_id != 2000006").collect()
    assert sorted((r["doc_id"] or -1, r["h"]) for r in got) == want
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
    spans = {r["doc_id"]: [(x["s"], x["e"], x["kind"]) for x in r["spans"]] for r in got}
    clean = pii.redact(df).where("doc_id != 2000006 and doc_id is not null").collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    assert len(clean) == len([r for r in rows if r["doc_id"] is not None])
    assert all(r["text"] == brute_redaction(text[r["doc_id"]], spans[r["doc_id"]]) for r in clean)
    assert text[10**6 + 8].startswith("é😀") and [k for *_, k in spans[10**6 + 8]] == [0, 1]
    assert pii.redact(odd).columns == odd.columns


def test_pii_selection(spark):
    """Formats that the base rules leave out are found with a word that announces them; what resembles them isn't."""
    right = {"mail joe [at] example [dot] com": ("email", 5, 31), "call 743-555-3824 now": ("phone", 5, 17), "tel (743) 555 3824": ("phone", 4, 18), "addr 2001:0db8:85a3:0000:0000:8a2e:0370:7334": ("ip", 5, 44)}
    wrong = ["The scores were 100 200 300 400", "In 2010 2015 2020", "1. 2. 3. 4", "on 2021-03-04 10 20", "sold 12 @ 3.45", "version 1 . 2 . 3 . 4", "isbn 978-3-16-148410-0", None, ""]
    rows = [*right, *wrong]
    got = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    for r in got:
        found = [(pii.KINDS[x["kind"]], x["s"], x["e"]) for x in r["spans"]]
        assert found == ([right[rows[r["doc_id"]]]] if rows[r["doc_id"]] in right else []), rows[r["doc_id"]]


def test_pii_calibration():
    assert pii.isotonic([(1.0, 0.0, 1.0), (2.0, 1.0, 1.0), (3.0, 0.0, 1.0), (4.0, 1.0, 1.0)]) == [(1.0, 0.0), (2.0, 0.5), (4.0, 1.0)]
    cell = lambda k, digits: (k, digits, 0, 0, 0, 0, 0)
    cells = [(cell(0, 1), True, 90.0), (cell(0, 2), False, 90.0), (cell(1, 1), True, 50.0)]
    limits = pii.calibrate(pii.fit(cells), cells)
    assert set(limits) == {0}  # the other kind has no wrong example
    for kind, right, _, text in pii.examples():
        digits = "".join(c for c in text if c.isdigit())
        assert kind != 2 or sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        assert right or brute_spans(text) == "" or kind == 2


def test_topk(spark):
    rows = [(i, [((i * 37 + k * 11) % 19 - 9) / 7 for k in range(6)]) for i in range(300)] + [(400, None), (450, [1.0, None] * 3), (500, [float("nan")] * 6), (None, [1.0] * 6), (7, [((7 * 37 + k * 11) % 19 - 9) / 7 for k in range(6)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows[:300]}
    want = [(q, r + 1, j, -s) for q in ints if q % 50 == 0 for r, (s, j) in enumerate(sorted((-int(ints[q] @ ints[j]), j) for j in ints if j != q)[:5])]
    keep = topk.SHARD, topk.LEAF
    try:
        for topk.SHARD in (10_000, 64):
            topk.LEAF = 8
            assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    finally:
        topk.SHARD, topk.LEAF = keep
    unlike = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [1.0, 2.0]), (51, [3.0, 1.0]), (100, []), (101, [])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(unlike).collect()) == [(0, 1, 1, 256 * 512), (50, 1, 51, 256 * 768 + 512 * 256), (100, 1, 101, 0)]
    big = spark.createDataFrame([(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:3] for r in topk.top_k(big).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert topk.quantised(spark.createDataFrame([(0, [3e20, -3e20, -0.001])], "vec_id long, embedding array<double>")).first()["v"] == [3e20 * 256, -3e20 * 256, -1.0]
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_balls(spark, monkeypatch):
    """Groups far apart and a third of all rows equal: shards that can't matter aren't visited, and the result is brute force's."""
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(2)
    centres = np.eye(8) * 9
    x = [centres[i % 8] + rng.normal(0, 0.1, 8) if i % 3 else centres[0] for i in range(900)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ints = np.floor(np.array(x) * 256).astype(int)
    want = [(q, r + 1, j, -s) for q in range(0, 900, 50) for r, (s, j) in enumerate(sorted((-int(ints[q] @ ints[j]), j) for j in range(900) if j != q)[:5])]
    visited, visits = [], topk._visits
    monkeypatch.setattr(topk, "_visits", lambda *a: visited.append(visits(*a)) or visited[-1])
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == want
    assert visited[0].agg(F.avg(F.size("to"))).first()[0] < 9  # of 18 pivots


def test_matroska(odd, none):
    text = {(r["doc_id"], r["text"]) for r in odd.collect()}
    for r in matroska.load(matroska.store(odd)).collect():
        data = bytes(r["payload"])
        assert len(data) % 576 == 0 and data and set(data[r["n_bytes"] :]) <= {255}
        assert any(i == r["doc_id"] and (t or "").encode() == data[: r["n_bytes"]] for i, t in text)
    assert matroska.load(matroska.store(none)).count() == 0
    assert matroska._laced(bytes([2, 3, 255, 0]) + bytes(3 + 255 + 4), 0, 4 + 262, 1) == [(4, 7), (7, 262), (262, 266)]
    assert matroska._laced(bytes([2, 0x83, 0xC1]) + bytes(3 + 5 + 4), 0, 15, 3) == [(3, 6), (6, 11), (11, 15)]


def brute_feature(text):
    data = (text or "").encode()
    data = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
    x = np.array(list(data), float) - 128
    turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    frames = len(data) // 576
    return data, f"packets={frames};clusters={-(-frames // 256)};cues={-(-frames // 256)};ms={frames * 72};mean={x.mean():.3f};dev={x.std():.3f};turns={turns}"


def test_matroska_query(spark, tmp_path, odd):
    """The query's columns against plain Python, over null, empty, repeated and long rows."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in odd.collect():
        data, feature = brute_feature(r["text"])
        media = matroska.write(data)
        want.append((r["doc_id"], len((r["text"] or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op6_matroska(spark, str(tmp_path)).collect())
    assert queries.media_packets(spark, str(tmp_path)).count() == sum(w[2] // 576 for w in want)


def test_matroska_parser():
    """Unknown sizes over frames that look like a cluster's head, scales, lacing times, groups with references, cues."""
    el, u = matroska._element, matroska._uint
    trap = matroska.CLUSTER.to_bytes(4, "big") + matroska.CUES.to_bytes(4, "big")
    info = el(matroska.INFO, u(matroska.SCALE, 500))
    tracks = el(matroska.TRACKS, el(matroska.TRACK, u(matroska.EVERY, 7000) + u(matroska.NUMBER, 1)) + el(matroska.TRACK, u(matroska.NUMBER, 2)))
    simple = lambda track, shift, flags, rest: el(matroska.SIMPLE_BLOCK, bytes([0x80 | track]) + shift.to_bytes(2, "big", signed=True) + bytes([flags]) + rest)
    one = u(matroska.TIME, 10) + simple(1, -2, 0x80 | 4, bytes([1]) + trap + trap[::-1]) + simple(2, 3, 2, bytes([1, 3]) + b"abcde")
    block = el(matroska.BLOCK, b"\x82\x00\x05\x00" + trap)
    two = u(matroska.TIME, 20) + el(matroska.GROUP, block + el(matroska.REFERENCE, b"\xff")) + el(matroska.GROUP, block)
    unknown = lambda ident, data: ident.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + data
    cues = el(matroska.CUES, el(matroska.CUE, u(matroska.CUE_TIME, 20) + el(matroska.CUE_PLACE, u(matroska.CUE_TRACK, 2) + u(matroska.CUE_CLUSTER, 99))))
    data = matroska._head() + unknown(matroska.SEGMENT, info + tracks + unknown(matroska.CLUSTER, one) + unknown(matroska.CLUSTER, two) + cues)
    found, marks = matroska.packets(data)
    assert [(t, ns, data[a:b], key, c) for t, ns, a, b, key, c in found] == [
        (1, 4000, trap, True, 0), (1, 11000, trap[::-1], True, 0), (2, 6500, b"abc", False, 0), (2, 6500, b"de", False, 0), (2, 12500, trap, False, 1), (2, 12500, trap, True, 1),
    ]
    base = data.index(info)
    assert marks == [(10000, 2, base + 99)]
    sized = matroska._head() + el(matroska.SEGMENT, info + tracks + el(matroska.CLUSTER, one) + el(matroska.CLUSTER, two) + cues)
    assert [p[:2] + p[4:] for p in matroska.packets(sized)[0]] == [p[:2] + p[4:] for p in found]
    with pytest.raises(ValueError):
        matroska.packets(sized[:-3])


def test_packing(odd, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    df = docs.select("doc_id", "text").union(odd.where("doc_id in (3, 4, 5, 7, 8)").select(F.col("doc_id") + 10**6, "text"))
    want = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    rows = pack.pack(df, queries.vocabulary()).collect()
    seen, sequences = {i: 0 for i in want}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == seen[r["doc_id"]] and ids == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(want[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {i: len(v) for i, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.05 * sum(map(len, want.values())) / 4096 + 1
    assert pack.pack(none, queries.vocabulary()).count() == 0


def test_word_tokens(monkeypatch):
    """Whole texts against the tokenizer itself: marks, case, scripts, long words, all white space, a memory that overflows, hashes that clash."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    rng = np.random.default_rng(4)
    letters = list("abcXYZ\u00e9\u00dc\u03a3\u03c3\u03c2\u0416\u4e2d\U0001f600\u0301.,;:!?)*#'-_%$0123456789 \t\n\x0b\x1c\x1f\x85\xa0\u2003\u3000<|>/")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(600)]
    texts += ["", " ", "x" * 5000, "word " * 300, "Donaudampfschiffahrtsgesellschaftskapit\u00e4n und Donaudampfschiffahrtsgesellschaftskapit\u00e4nin", "\u65e5\u672c\u8a9e" * 40, "</w> <|endoftext|> a</w>b"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    own = pack.WordTokens(queries.vocabulary())
    assert [x.tolist() for x in own(texts)] == want and [x.tolist() for x in own(texts[::-1])] == want[::-1]
    assert own([]) == []
    monkeypatch.setattr(pack, "_CACHE", 50)
    small = pack.WordTokens(queries.vocabulary())
    assert [small([t])[0].tolist() for t in texts] == want
    monkeypatch.setattr(pack, "_MIX", (0, 0, 0, 8))  # every word of a length has one hash
    clash = pack.WordTokens(queries.vocabulary())
    assert [x.tolist() for x in clash(texts)] == want and [x.tolist() for x in clash(texts[::-1])] == want[::-1]


def test_packing_separators(spark):
    """Information separators are tokens, not white space."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    texts = ["a\x1cb", "x\x1d \x1e y\x1f", "\x1c\x1d", "Word\x1e, word.\x1f\u2003z\x85q\xa0r", "a\x0bb\x0cc"]
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in pack.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.vocabulary()).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_mixing(odd, docs, none):
    for df in (docs, odd):
        got = mixing.mix(df).collect()
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in got) and len(got) == df.count()
        by = {}
        for r in got:
            by.setdefault((r["source_size"], r["target"]), 0)
            by[r["source_size"], r["target"]] += r["taken"]
        assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
        assert all(t <= 2 * s + 1e-6 for s, t in by)
        if df is docs:
            assert all(abs(taken - t) <= max(2, 0.01 * t) for (_, t), taken in by.items())
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r["taken"] for r in mixing.mix(docs).collect())


def test_mixing_repeated_rows(spark):
    """Rows that share an id, an id and a text, or have none, are drawn one by one; reruns and other partitions agree."""
    rows = [(7, "a b c d e f g h i j", "s0")] * 200 + [(None, "k l m n o p q r s t", "s1")] * 200 + [(9, f"{i} " * 10, "s2") for i in range(200)] + [(i, "u v w x y z 1 2 3 4", "s3") for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault((r["doc_id"] if r["doc_id"] in (7, 9, None) else 0, r["target"]), []).append(r["taken"])
    assert len(got) == len(rows) and all(abs(sum(t) - target) <= 1 for (_, target), t in by.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mixed(df).select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r["taken"] for r in got)


def test_mixing_cap(spark):
    """Sources with many long documents whose rate is the cap: none gets a copy more."""
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(min(600, rng.lognormal(3.5, 1.2)) + 1), f"s{i % 60:02d}") for i in range(3600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["copies"] <= 2 and r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((rows[r["doc_id"]][2], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - t) <= 1 for (_, t), taken in by.items())


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        out[i] = sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def test_suffix(spark, docs, odd, none):
    line = "the quick brown fox jumps over the lazy dog and runs far away from all the hounds of this very long line, twice."
    extra = [(10**6 + i, t) for i, t in enumerate([line, f"x{line}y", "ab" * 400, line[:99], None, "", f"é{line * 3}"])]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = brute_repeats(df.orderBy("doc_id").collect())
    for r in suffix.remove_repeats(df).collect():
        assert (sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
    assert suffix.remove_repeats(odd).count() == 13 and suffix.remove_repeats(none).count() == 0


def removed(df):
    return {r["doc_id"]: (sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in suffix.remove_repeats(df).collect()}


def copies_and_edits():
    """Groups of exact copies, copies with an edit, and texts that share a passage, in an order that mixes groups."""
    rng = np.random.default_rng(3)
    line = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common, rows = line(90), []
    for g in range(40):
        base, at = line(300), int(rng.integers(100, 200))
        rows += [(g, base), (1000 + 3 * g, base[:at] + "#" + base[at + 1 :]), (1001 + 3 * g, base), (1002 + 3 * g, line(80) + base[50:260] + line(20))]
        rows += [(2000 + g, line(60) + common + line(60)), (3000 + g, base[:170] + common + base[170:])]
    return rows


def test_suffix_any_partitions(spark):
    """One row a task, all in one, and two tasks give what brute force gives."""
    rows = copies_and_edits()
    want = brute_repeats(sorted(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for split in (df.repartition(len(rows)), df.coalesce(1), df.repartitionById(2, (F.col("doc_id") >= 1000).cast("int")), df.repartitionById(3, (F.col("doc_id") % 3).cast("int"))):
        assert removed(split) == want


def test_suffix_levels(monkeypatch):
    """Batches of any size, in any order, settle in an index what brute force finds; frequent anchors that step back change nothing."""
    rows = [(i, t.encode()) for i, t in [*copies_and_edits(), (5000, "ab" * 300), (5001, "\0" * 250), (5002, "x" + "\0" * 140 + "y")]]
    monkeypatch.setattr(suffix, "SEGMENT", 150)
    seen, want = set(), set()
    for i, t in sorted(rows):
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                want.add((i, p))
            seen.add(t[p : p + 100])
    rng = np.random.default_rng(1)
    grams = suffix.Anchors().runs(np.frombuffer(b"".join(t for _, t in rows), np.uint8), np.append(0, np.cumsum([len(t) for _, t in rows])[:-1]))[0]
    for size, hot in ((1, None), (7, None), (50, grams[::2]), (10**6, grams), (13, np.unique(grams)[:5])):
        index, found, order = suffix.Family(), [], rng.permutation(len(rows))
        for k in range(0, len(order), size):
            texts = suffix._Texts([(rows[j][0], 0, rows[j][1]) for j in order[k : k + size]], suffix.Anchors(hot=hot))
            found += index.add(texts.entries(np.arange(len(texts.at)), suffix.entry_type(100, 32)))
            sizes = [len(x) for x in index.levels]
            assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        got = [(int(u), p) for us, los, his in found for u, lo, hi in zip(us, los, his, strict=True) for p in range(lo, hi + 1)]
        assert set(got) == want and len(got) == len(want)


def test_language(spark, docs, odd, none):
    got = language.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).alias("g")
    r = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").alias("d"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert r[0] > 0.97
    held = {r["doc_id"]: r["held_out"] for r in language.identify(docs).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    rows = language.identify(odd).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 8)} == {"und"} and len(rows) == 13
    marks = spark.createDataFrame([(1, "\u00bd \u00b2 \u2460 12_\u0663"), (2, "\u00e9"), (3, "\U00010400")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert [r["lang_pred"] == "und" for r in language.identify(marks).orderBy("doc_id").collect()] == [True, False, False]
    assert language.identify(none).count() == 0
    assert language.keep_known(odd).columns == odd.columns


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(p.STAGES):
        docs = p.written(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.count() and (i == len(p.STAGES) - 1 or docs.columns == columns)
