"""Operators 2, 4, 7, 9 and 10 and the pipeline."""

import gc
import math
import random
import re
import weakref
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roundlearn.llm import langid, licenses, queries, secrets, subword, token_counts, toxicity
from roundlearn.llm.common import held_out, read_table
from tests.llm import brute
from tests.llm.conftest import SF, SF_MID


# ---- 2: SentencePiece with merge dropout

@pytest.fixture(scope="module")
def merger():
    return subword.Merger(subword.load_pieces())


def test_no_dropout_is_the_model(spark, merger):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=subword.MODEL)
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    df = spark.createDataFrame(rows + [(-1, "  two  spaces "), (-2, "a\n\nb\n"), (-3, "日本語 😀"), (-4, "x" * 400)],
                               "doc_id long, text string")
    for r in subword.encode(df, dropout=0.0).join(df, "doc_id").collect():
        assert r.ids == sp.encode(r.text) and r.n_tokens == len(r.ids) and r.lossless


def test_both_merge_paths_agree(merger):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdeth  é▁日ing\n", k=rnd.randrange(1, 33))) for _ in range(1500)]
    keys = np.array([rnd.getrandbits(64) for _ in words], np.uint64)
    for rate in (0, 0.1, 0.6):
        limit = int(rate * 2.0**64)
        assert merger.together(words, keys, limit) == [
            merger.by_agenda(w, k, limit) for w, k in zip(words, keys.tolist(), strict=True)]


def test_dropout_varies_by_seed_and_decodes(spark, odd, empty):
    a = subword.encode(odd, seed=1, variants=1)
    b = subword.encode(odd, seed=2, variants=1)
    rows = {(r.doc_id, r.ids_sha256) for r in a.collect()}
    assert rows == {(r.doc_id, r.ids_sha256) for r in subword.encode(odd.repartition(5), seed=1, variants=1).collect()}
    assert rows != {(r.doc_id, r.ids_sha256) for r in b.collect()}
    for enc in (a, b, subword.encode(odd, dropout=0.9)):
        got = enc.collect()
        assert all(r.lossless for r in got) and len(got) == odd.count()
        assert sorted((r.text or "", r.n_tokens) for r in subword.decode(enc).collect()) == sorted(
            (r.text or "", n) for r, n in zip(odd.collect(), [x.n_tokens for x in got], strict=True))
    assert all(r.ids is None for r in a.where("doc_id = 1").collect())
    assert subword.encode(empty).count() == 0


def test_pretokens_are_cut_as_arrays():
    rnd, plain = random.Random(3), re.compile(r"\n| *[^ \n]+| +")
    for _ in range(400):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choices("a é\n\t", k=rnd.randrange(9))) for _ in range(rnd.randrange(6))]
        cut, sizes = subword.pretokens(texts)
        want = [plain.findall(" " + t) if t else [] for t in texts]
        assert cut.to_pylist() == [w for c in want for w in c] and sizes.tolist() == [len(c) for c in want]


def test_encoder_remembers_repeated_words_only(merger, monkeypatch):
    monkeypatch.setattr(subword, "CACHED", 50)
    enc = subword.Encoder(merger)
    for part in range(20):
        once = " ".join(f"once{part}x{i}" for i in range(300))
        enc.encode([f"{once} again again", " ".join(2 * [f"twice{part}x{i}" for i in range(30)])], [part, -part])
        assert not any("once" in w for w in enc.known) and " again" in enc.known
        assert len(enc.known) + len(enc.old) <= 2 * (50 + 35)


def test_encoder_holds_a_bounded_memory_of_words(merger):
    enc = subword.Encoder(merger)
    for part in range(14):
        enc.encode([" ".join(2 * [f"t{part}x{i}" for i in range(10_000)])], [part])
        assert len(enc.known) + len(enc.old) <= 120_000


def test_encoder_looks_up_the_pairs_of_a_word_once(merger, monkeypatch):
    looked, get = [], merger.table.get
    monkeypatch.setattr(merger.table, "get", lambda keys: looked.append(len(keys)) or get(keys))
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdeth", k=rnd.randrange(2, 12))) for _ in range(500)]
    enc = subword.Encoder(merger, dropout=0.99)                # few merges follow
    enc.encode([" ".join(words)] * 20, list(range(20)))
    assert sum(looked) < 4 * sum(map(len, words))


@pytest.mark.parametrize("rate", [0, 0.1, 0.7])
def test_encoder_against_one_pretoken_at_a_time(merger, monkeypatch, rate):
    monkeypatch.setattr(subword, "COLUMNS", 7)                # several matrices of a length
    monkeypatch.setattr(subword, "CACHED", 20)                # and several generations of remembered words
    rnd = random.Random(11)
    enc = subword.Encoder(merger, dropout=rate)
    some = ["".join(rnd.choices("abcdething é▁日😀\t\0", k=rnd.randrange(1, 40))) for _ in range(60)]
    for part in range(8):
        texts = [rnd.choice([None, "", " ", "\n", "a", "▁"]) if rnd.random() < 0.3 else
                 rnd.choice([" ", "\n", "  "]).join(rnd.choices(some, k=rnd.randrange(1, 30))) for _ in range(12)]
        ids = [rnd.choice([None, part, -7]) for _ in texts]
        ids_flat, ends = enc.encode_flat(texts, ids)
        raw, stops = merger.decoded(ids_flat, ends)
        assert raw == b"".join((" " + t).encode() for t in texts if t)
        assert np.diff(stops, prepend=0).tolist() == [len((" " + t).encode()) if t else 0 for t in texts]
        for t, d, got in zip(texts, ids, enc.encode(texts, ids), strict=True):
            want, stream = [], subword._scramble(enc.stream(d))
            for i, w in enumerate(re.findall(r"\n| *[^ \n]+| +", " " + t) if t else []):
                want.append(merger.by_agenda(w, subword._scramble((stream + i) % 2**64), enc.limit))
            assert got == (None if t is None else b"".join(want))


def test_decoded_bytes_follow_the_ids(merger):
    ids, ends = subword.Encoder(merger).encode_flat(["one two", None, "", "three"], [1, 2, 3, 4])
    raw, stops = merger.decoded(ids[::-1], ends)
    assert raw != b" one two three" and len(raw) == 14 and stops[-1] == 14 and len(stops) == 4


def test_encoder_goes_with_its_vocabulary():
    class Shared:
        value = subword.load_pieces()
    shared = Shared()
    enc = weakref.ref(subword._encoder(shared, 0.1, 7, None))
    assert subword._encoder(shared, 0.1, 7, None) is enc() and subword._encoder(shared, 0.0, 7, None) is not enc()
    enc = weakref.ref(subword._encoder(shared, 0.0, 7, None))
    del shared
    gc.collect()
    assert enc() is None


def test_dropout_draws_each_occurrence(merger):
    word, limit = "international", int(0.1 * 2.0**64)
    enc = subword.Encoder(merger)
    text = " ".join([word] * 400)
    docs = enc.encode([text] * 30, list(range(30)))
    assert len(set(docs)) == 30 and enc.encode([text], [7]) == [docs[7]]           # no streams shared, repeatable
    alone = [merger.by_agenda(" " + word, k, limit) for k in range(1, 12_001)]
    apart = Counter(x for d in range(30) for x in _cut_words(merger, docs[d], " " + word).elements())
    assert len(apart) > 4 and len(_cut_words(merger, docs[0], " " + word).keys()) > 4   # many within one document
    most, n = Counter(alone).most_common(1)[0]
    assert abs(apart[most] - n) < 400                          # the law of the merges themselves, of 12 000 draws


def _cut_words(merger, raw, word):
    out, ids, at = Counter(), np.frombuffer(raw, np.int32).tolist(), 0
    for i in range(1, len(ids) + 1):
        if len(b"".join(merger.bytes_of[x] for x in ids[at:i])) == len(word):
            out[np.array(ids[at:i], np.int32).tobytes()] += 1
            at = i
    return out


# ---- 9: token counts

def best_cut(w, scores):
    best = [(0.0, 0)]
    for j in range(1, len(w) + 1):
        best.append(max((scores[w[i:j]] + best[i][0], best[i][1] - 1) for i in range(j) if w[i:j] in scores))
    return -best[-1][1], best[-1][0]


def test_counts_against_brute_force(spark, odd, empty):
    scores = token_counts.load_scores()
    docs = read_table(spark, SF, "documents").select("doc_id", "text").limit(40).unionByName(
        odd.select("doc_id", "text").where("length(text) < 6000 or text is null"))
    known = {}

    def of(t):
        words = token_counts.PRETOKEN.findall(t.encode()) if t else []
        for w in words:
            if w not in known:
                known[w] = best_cut(w, scores)
        return len(words), sum(known[w][0] for w in words), round(sum(known[w][1] for w in words), 4)
    got = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens, round(r.log_prob, 4))
                 for r in token_counts.count_tokens(docs).collect())
    want = sorted((str(r.doc_id), *of(r.text)) for r in docs.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-3 for g, w in zip(got, want))
    assert token_counts.count_tokens(empty).count() == 0


def test_levels_equal_paths():
    counter = token_counts.Counter(token_counts.load_scores())
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choices("abcething éß", k=rnd.randrange(1, 16))).encode()[:32] for _ in range(3000)} - {b""})
    assert counter.by_level(words) == counter.walk(words)


# ---- 10: language

def test_language_held_out(spark):
    got = queries.op10_language_id(spark, SF_MID).join(read_table(spark, SF_MID, "documents"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd, empty):
    model = langid.fit(read_table(spark, SF, "documents"), F.lit(True))
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    letters = {r.doc_id: bool(r.text and any(c.isalpha() for c in r.text)) for r in odd.collect() if r.doc_id not in (None, 10, 5)}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in got if r.doc_id in letters)
    assert langid.predict(empty, model).count() == 0
    assert langid.fit(empty, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_held_out_rows_and_names_do_not_matter(spark):
    docs = read_table(spark, SF, "documents")
    learn = ~held_out(F.col("doc_id"))
    a = langid.fit(docs, learn)
    changed = docs.withColumn("lang", F.when(learn, F.col("lang")).otherwise(F.lit("en")))
    b = langid.fit(changed, learn)
    assert a["labels"] == b["labels"] and np.array_equal(a["w"], b["w"]) and a["t"] == b["t"]


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 2000)
    logits = rng.normal(size=(2000, 3)) * 6 + 6 * np.eye(3)[y]
    t = langid.temperature(logits, y)
    loss = lambda k: -np.mean(np.log(langid._softmax(logits / k)[np.arange(2000), y]))
    assert loss(t) <= min(loss(0.5), loss(1.0), loss(2.0), loss(5.0)) + 1e-9


# ---- 7: toxicity

def toxic_docs(n=1600):
    rnd = random.Random(4)
    clean = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        sents = [" ".join(rnd.choices(clean, k=rnd.randrange(3, 12))) for _ in range(rnd.randrange(1, 15))]
        bad = i % 5 == 0
        if bad:
            j = rnd.randrange(len(sents))
            sents[j] += f" vile{rnd.randrange(4)}"
        rows.append((i, ". ".join(sents).capitalize() + ".", int(bad)))
    return rows


def test_toxicity_finds_documents_and_sentences(spark):
    rows = toxic_docs()
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int").repartition(4)
    learn = ~held_out(F.col("doc_id"))
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), learn)
    got = toxicity.score(df, model).join(df, "doc_id").collect()
    out = [r for r in got if brute.crc(r.doc_id) % 4 == 2]
    assert sum((r.score >= 0.3) == bool(r.toxic) for r in out) >= 0.99 * len(out)
    for r in out:
        if r.toxic and r.score >= 0.3:
            assert any("vile" in r.text[s["start"]:s["end"]].lower() for s in r.sentences)
            assert all("." not in r.text[s["start"]:s["end"]] for s in r.sentences)


def test_toxicity_odd_rows(spark, odd, empty):
    df = spark.createDataFrame(toxic_docs(200), "doc_id int, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), F.lit(True))
    got = {(r.doc_id, r.score) for r in toxicity.score(odd, model).collect()}
    assert (1, 0.0) in got and (2, 0.0) in got and all(0 <= s <= 1 for _, s in got)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(odd, df.select("doc_id", "toxic").where("toxic = 1"), F.lit(True)) is None
    assert toxicity.fit(odd, df.select("doc_id", "toxic").where("doc_id < 0"), F.lit(True)) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_toxicity_on_table(spark):
    got = queries.op7_toxicity(spark, SF_MID).join(read_table(spark, SF_MID, "labels"), "doc_id").collect()
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    seen = [r for r in got if not r.held_out]
    assert sum(r.predicted == r.toxic for r in seen) >= 0.97 * len(seen)


# ---- 4: licences

def plain_licences(rows, min_cosine=licenses.MIN_COSINE):
    """rows: (id, path, is_file, text)."""
    term = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
    heads = []
    for _, path, _, text in rows:
        name = (path or "").split("/")[-1]
        if re.search(licenses.NAMES, name) and (text or "").strip(" "):
            heads.append(text)
        else:
            lines = [x.strip(" ") for x in (text or "").split("\n") if re.search(licenses.CUE, x)]
            heads.append("\n".join(lines) if lines else None)
    bags = [Counter(term.findall(h.lower())) if h is not None else None for h in heads]
    tpl = {k: Counter(term.findall(v.lower())) for k, v in licenses.TEMPLATES.items()}
    df = Counter(t for b in [*filter(None, bags), *tpl.values()] for t in b)
    n = sum(h is not None for h in heads) + len(tpl)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    vec = lambda b: {t: math.log1p(c) * idf[t] for t, c in b.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    tv = {k: vec(b) for k, b in tpl.items()}
    own = []
    for b in bags:
        best = None
        if b:
            v = vec(b)
            for k in sorted(tv):
                c = round(sum(x * tv[k].get(t, 0) for t, x in v.items()) / norm(v) / norm(tv[k]), 6)
                if c >= min_cosine and (best is None or c > best[0]):
                    best = (c, k)
        own.append(best)
    holders = {}
    for (_, path, is_file, _), o in zip(rows, own):
        d, _, name = (path or "").rpartition("/")
        if o and (is_file or re.search(licenses.NAMES, name)):
            holders.setdefault(d, []).append((-o[0], name, o[1]))
    out = []
    for (i, path, _, _), o in zip(rows, own):
        d = (path or "").rpartition("/")[0]
        found = where = None
        while o is None:
            if d in holders:
                found, where = min(holders[d])[2], d
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        out.append((i, o and o[1], o and o[0], o[1] if o else found, where))
    return out


def test_licences_against_plain_version(spark):
    rows = [
        (1, "a/LICENSE", False, "This work is licensed under the GNU General Public License, version 3."),
        (2, "a/b/c/x.py", False, "code\nmore code"), (3, "a/b/LICENSE.txt", False, "Released under the MIT License."),
        (4, "a/b/c/y.py", False, "# Licensed under the Apache License, Version 2.0.\ncode"), (5, "q/z", False, "nothing"),
        (6, "a/top", False, None), (7, None, False, "Copyright someone, licensed to nobody at all in particular here"),
        (8, "a/b/COPYING", False, "Released under the ISC License."), (9, "a/bb/x", False, ""), (9, "a/bb/x", False, ""),
        (None, "a/b/n", False, "x"), (11, "m/one", True, "SPDX-License-Identifier MPL, Mozilla Public License 2.0"),
        (12, "m/two/three", False, "y"), (13, "m/LICENSE", False, "   "), (14, "a/b/c/d/e/f/g", False, "deep"),
        (15, "r/s/t", False, "Released under the MIT License. And Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id int, path string, is_file boolean, text string")
    got = licenses.scan(df, F.col("path"), F.col("is_file"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_licences(rows), key=key)
    assert licenses.scan(df.where("doc_id < 0"), F.col("path")).count() == 0


def test_licences_on_table(spark):
    docs = read_table(spark, SF, "documents").collect()
    rows = [(r.doc_id, f"{r.source}/{r.lang}/{r.doc_id}",
             len(re.split(r"\s+", r.text.strip(" "))) <= 64 and bool(re.search(licenses.CUE, r.text)), r.text) for r in docs]
    assert sorted(map(str, map(tuple, queries.op4_license_scan(spark, SF).collect()))) == sorted(map(str, plain_licences(rows)))


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at"""
GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MIT = """Copyright (c) 2020 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Copyright (c) 2020, Jane Roe. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


@pytest.mark.parametrize("line", ["# " * 500_000, "1." * 500_000, "a-" * 500_000, "// " * 300_000, "rem " * 250_000, "* " * 500_000,
                                  "<!--" * 250_000], ids=lambda x: x[:4])
def test_long_marks_do_not_overflow(spark, line):
    """A megabyte of comment marks, points or hyphens in one line (Java's
    matcher recurses for repeated groups that are not possessive)."""
    rows = [(1, "src/a", f"Released under the MIT License.\n{line}"), (2, "src/b", f"license {line}")]
    df = spark.createDataFrame(rows, "doc_id int, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.scan(df, F.col("path")).collect()}
    assert set(got) == {1, 2} and got[1] == "MIT"


def test_licences_real_headers(spark):
    marked = lambda mark, t: "\n".join(mark + x for x in t.split("\n")) + "\n\nimport os\n\nprint(os.name)"
    prose = "\n".join(f"A line of plain words, number {i}, about a copyright of old" for i in range(30))
    want = [
        ("Apache-2.0", "a.py", marked("# ", APACHE)), ("Apache-2.0", "b.java", "/*\n" + marked(" * ", ASF)),
        ("GPL-3.0", "c.py", marked("# ", GNU)), ("GPL-2.0", "d.c", marked("// ", GNU.replace("version 3", "version 2"))),
        ("LGPL-2.1", "e.c", marked("// ", GNU.replace("GNU", "GNU Lesser").replace("version 3", "version 2.1"))),
        ("AGPL-3.0", "f.c", marked("// ", GNU.replace("GNU", "GNU Affero"))), ("MIT", "g/LICENSE", MIT), ("MIT", "h.js", MIT),
        ("BSD-2-Clause", "i/LICENSE", BSD), ("BSD-3-Clause", "j.c", marked("// ", BSD3)),
        ("MIT", "k.py", "# SPDX-License-Identifier: MIT\nx"), ("Apache-2.0", "l.py", "# SPDX-License-Identifier: Apache-2.0"),
        ("GPL-3.0", "m.c", "/* SPDX-License-Identifier: GPL-3.0-or-later */"),
        ("MIT", "n.py", "# Copyright 2020 Jane Roe. All rights reserved.\n# SPDX-License-Identifier: MIT"),
        (None, "o.py", "# SPDX-License-Identifier: Zlib"), (None, "p.py", "# Released under the Quux Community License of Mars"),
        ("MIT", "q.md", prose + "\nReleased under the MIT License.\n" + prose), (None, "r.md", prose),
    ]
    full = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
            "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for name, licence in full.items():                       # full texts, where the system has them
        path = Path("/usr/share/common-licenses") / name
        if path.exists():
            want.append((licence, f"{name}/LICENSE", path.read_text()))
    rows = [(i, f"x{i}/{p}", t) for i, (_, p, t) in enumerate(want)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id int, path string, text string"), F.col("path"))
    got = {r.doc_id: r.own_license for r in got.collect()}
    assert [(p, got[i]) for i, (_, p, _) in enumerate(want)] == [(p, k) for k, p, _ in want]


# ---- the pipeline

def test_pipeline_against_plain_version(spark):
    docs = {r.doc_id: r for r in read_table(spark, SF, "documents").collect()}
    verdict = {r.doc_id: r.kept for r in queries.op5_quality_rules(spark, SF).collect()}
    left = [(d, r.text) for d, r in docs.items() if verdict[d]]
    left = [(d, docs[d].text) for d, _, c in brute.components(left) if d == c]
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").collect()]
    left = [(d, brute.without_windows(docs[d].text, items)) for d, *_, bad in brute.contamination(left, items) if not bad]
    want = {d: secrets.redacted(t, secrets.scan(t)[1]) for d, t in left}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.text for r in subword.decode(got).collect()} == want
    assert all(r.lang == docs[r.doc_id].lang and r.n_tokens == len(r.ids) for r in got.collect())


def test_stages_on_odd_and_empty_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        out = stage(spark, odd, SF)
        if name != "encode":
            assert out.schema.names == odd.schema.names
        assert out.count() <= odd.count()


def test_noisy_or_fit_against_a_plain_one():
    """The fit is at a minimum of the plainly written loss: its numerical
    gradient is flat there, and steps in any direction do not lower it."""
    rng = np.random.default_rng(2)
    bags = [[rng.choice(6, size=rng.integers(1, 4), replace=False) for _ in range(rng.integers(1, 5))] for _ in range(120)]
    y = np.array([any(0 in s and 1 not in s for s in b) for b in bags])
    weight = np.where(y, 1.0, 2.0)
    doc = np.array([d for d, b in enumerate(bags) for _ in b])
    sent, feat = np.array([(i, f) for i, s in enumerate(s for b in bags for s in b) for f in s]).T
    w, bias, losses = toxicity.fit_weights(doc, (sent, feat), y, weight, 6, ridge=0.05, tolerance=1e-12)

    def loss(theta):
        total = 0.0
        for b, t, k in zip(bags, y, weight):
            none = 1.0
            for s in b:
                none *= 1 - 1 / (1 + np.exp(-(theta[-1] + sum(theta[f] for f in s))))
            total -= k * np.log(1 - none if t else none)
        return total / weight.sum() + 0.5 * 0.05 * (theta[:-1] ** 2).sum() / 6
    at = np.append(w, bias)
    assert abs(loss(at) - losses[-1]) < 1e-9 and all(b < a for a, b in zip(losses, losses[1:]))
    for i in range(7):
        e = np.eye(7)[i] * 1e-4
        assert abs(loss(at + e) - loss(at - e)) / 2e-4 < 1e-4
    for d in rng.normal(size=(50, 7)) * 0.05:
        assert loss(at + d) >= losses[-1] - 1e-9


def test_ftrl_against_a_plain_one():
    """The array updates give the weights of the update written out number
    by number, and a larger penalty leaves fewer of them."""
    rng = np.random.default_rng(3)
    examples = []
    for _ in range(60):
        at = np.sort(rng.choice(20, size=4, replace=False))
        x = rng.random(4)
        examples.append((at, x / np.linalg.norm(x), int(at[0] % 3)))
    alpha, beta, l2, share = 1.0, 1.0, 1e-4, []
    for l1 in (0.0, 0.2, 1.0):
        z, n = [[0.0] * 3 for _ in range(20)], [[0.0] * 3 for _ in range(20)]
        bias, bias_n = [0.0] * 3, [0.0] * 3

        def solve(zi, ni, l1=l1):
            return 0.0 if abs(zi) <= l1 else ((1 if zi > 0 else -1) * l1 - zi) / ((beta + ni ** 0.5) / alpha + l2)
        order = np.arange(60)
        for e in range(2):
            np.random.default_rng(e).shuffle(order)
            for i in order.tolist():
                at, x, y = examples[i]
                s = [sum(x[j] * solve(z[a][k], n[a][k]) for j, a in enumerate(at)) + bias[k] for k in range(3)]
                p = [np.exp(v) for v in s]
                p = [v / sum(p) - (k == y) for k, v in enumerate(p)]
                for j, a in enumerate(at):
                    for k in range(3):
                        g = x[j] * p[k]
                        w = solve(z[a][k], n[a][k])
                        z[a][k] += g - ((n[a][k] + g * g) ** 0.5 - n[a][k] ** 0.5) / alpha * w
                        n[a][k] += g * g
                for k in range(3):
                    bias_n[k] += p[k] ** 2
                    bias[k] -= 0.1 * p[k] / (1 + bias_n[k] ** 0.5)
        w, b = langid.train(examples, 3, 20, 2, alpha, beta, l1, l2)
        assert np.allclose(w, [[solve(z[a][k], n[a][k]) for k in range(3)] for a in range(20)]) and np.allclose(b, bias)
        share.append((w != 0).mean())
    assert share[0] > share[1] > share[2]


def test_language_model_tells_its_fit(spark):
    model = langid.fit(read_table(spark, SF_MID, "documents"), F.lit(True))
    assert model["l1"] in langid.L1 and 0 < model["nonzero"] < 0.9 and 0 <= model["loss"] < 0.5 and 0.01 < model["t"] < 100
