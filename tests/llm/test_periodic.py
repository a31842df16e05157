"""Operator 12 against a plain search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from roundlearn.llm import periodic, queries
from roundlearn.llm.common import read_table
from tests.llm import brute
from tests.llm.conftest import SF, SF_MID


def all_runs(s, least):
    """(start, length, period) of every run, by every period."""
    out, n = [], len(s)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, 2 * p) and not any(
                    all(s[k] == s[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    w = brute.words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w, 12)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)), n)


def same(got, want):
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_table(spark):
    rows = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    want = [plain(r.doc_id, r.text) for r in rows if len(brute.words(r.text)) <= 1500]
    ids = {w[0] for w in want}
    got = [r for r in queries.op12_periodic_runs(spark, SF).collect()]
    assert len(got) == len(rows) and len(want) > 150
    same([r for r in got if r.doc_id in ids], want)
    assert any(r.n_runs for r in got)


def test_short_texts_of_the_larger_table(spark):
    rows = read_table(spark, SF_MID, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF_MID).collect()}
    for r in rows:
        if len(brute.words(r.text)) <= 400:
            assert got[r.doc_id] == plain(r.doc_id, r.text)


def test_odd_rows(spark, odd, empty):
    got = periodic.runs_digest(odd, rewrite=periodic.planted_tail).collect()
    same([r for r in got if r.n_words < 5000], [plain(r.doc_id, r.text) for r in odd.collect() if len(brute.words(r.text)) < 5000])
    assert periodic.runs_digest(empty).count() == 0
    assert {r.n_runs for r in got if r.n_words == 30_000} == {0}


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_sequences(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        s = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randrange(60))]
        assert list(map(tuple, periodic.runs_of(np.array(s, np.int64), 2).tolist())) == all_runs(s, 2)


@pytest.mark.parametrize("seed", range(6))
def test_cut_loses_no_run(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        docs = []
        for _ in range(rnd.randrange(1, 10)):
            s = []
            for _ in range(rnd.randrange(6)):
                u = [rnd.randrange(rnd.choice([2, 30])) for _ in range(rnd.randrange(1, 16))]
                s += u if rnd.random() < 0.5 else (u * 9)[:rnd.randrange(1, 9 * len(u))]
            docs.append(s)
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = periodic.runs_of_documents(np.array(sum(docs, []), np.int64), starts)
        for d, g in zip(docs, got):
            assert ([] if g is None else list(map(tuple, g.tolist()))) == all_runs(d, 12)


@pytest.mark.parametrize("s", [np.zeros(60_000, np.int64), np.tile(np.arange(500), 120), np.arange(60_000) % 7 // 6])
def test_long_periodic_sequences(s):
    p = {1: 1}.get(len(np.unique(s[:7])), 500 if s.max() > 10 else 7)
    assert periodic.runs_of(s, 12).tolist() == [[0, 60_000, p]]


def test_texts_of_runs(spark):
    t = "a b c " * 6 + "x y z " + "q " * 12
    r = periodic.find_runs(spark.createDataFrame([(1, t)], "doc_id int, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 18, 3), (21, 12, 1)]
    assert r.collapsed == "a b c x y z q"
