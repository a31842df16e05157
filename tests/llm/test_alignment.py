"""Operator 11 against a plain version: whole-text encoding, sets of ends,
loops over groups, and counts in one dictionary."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from roundlearn.llm import alignment, queries
from roundlearn.llm.common import read_table
from tests.llm.conftest import ODD, SF, SF_MID


@pytest.fixture(scope="module")
def encoder():
    return alignment.Encoder(alignment.VOCABULARY_A, alignment.MODEL_B)


def plain(encoder, rows):
    """Rows of the contract, by whole texts."""
    docs, held = [], Counter()
    for d, t in rows:
        a = encoder.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = encoder.b.encode(t) if t else []
        x, y = ([side[i] for i in ids] for side, ids in ((encoder.a_bytes, a), (encoder.b_bytes, b)))
        if not t or not b"".join(x) == b"".join(y) == (" " + t).encode():
            a, b, x, y = [], [], [], []
        ends_a, ends_b = (np.cumsum([len(i) for i in side], dtype=int).tolist() for side in (x, y))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links, i, j = [], Counter(), 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(a) and ends_a[i] <= c:
                ga.append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= c:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.update((u, v) for u in ga for v in gb)
        held.update(links.keys())
        docs.append((d, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (u, _), n in held.items():
        most[u] = max(most[u], n)
    return [(d, na, nb, len(g), sum(k.values()), sum(n for p, n in k.items() if held[p] == most[p[0]]),
             sum(n * held[p] for p, n in k.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, na, nb, g, k in docs]


def same(got, want):
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("sf", [SF, SF_MID])
def test_tables(spark, encoder, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    same(queries.op11_token_alignment(spark, sf).collect(), plain(encoder, rows))


@pytest.mark.parametrize("hot_pairs", [0, 20, 300])
def test_rare_pairs_by_the_join(spark, encoder, odd, hot_pairs):
    """The same rows, whatever part of the pairs is sent to the tasks."""
    rows = [(d, t) for d, t in ODD] + [(100 + i, f"word{i % 3} and more {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(alignment.align(df, hot_pairs=hot_pairs).collect(), plain(encoder, rows))
    same(alignment.align(odd, hot_pairs=hot_pairs).collect(), plain(encoder, [(r.doc_id, r.text) for r in odd.collect()]))


def test_empty(empty):
    assert alignment.align(empty).count() == 0
    assert alignment.align(empty).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


SPECIAL = ["<|endoftext|> x<|endoftext|>", "<s> </s> <unk>", "▁mark", "a▁b", " ", "   ", " a", "a ", "a  ", "\n", " \n a\n\n b ",
           "\t\ta", "a  b", "a  b", "a 　b", "a\x1c b", "日本語 テキスト。😀😀 👨‍👩‍👧", "x" * 3000, "ab" * 500, " " * 700,
           "<0x41> <0x0A>", "é é", "1234567890" * 30, "it's we'll I'd 'tis", "ﬁ ① ſ", "\x00 \x00",
           "a\u0085b", "​ x", "'  's"]


def test_chunks_give_the_ids_of_whole_texts(encoder):
    rnd = random.Random(4)
    texts = SPECIAL + ["".join(rnd.choices("ab Z\n\té日😀'1▁.  ", k=rnd.randrange(1, 80))) for _ in range(3000)]
    a, n_a, b, n_b = encoder.tokens(texts)
    a, b = ([x.tolist() for x in np.split(side, np.cumsum(n)[:-1])] for side, n in ((a, n_a), (b, n_b)))
    for t, x, y in zip(texts, a, b):
        wa, wb = encoder.a.encode(" " + t, add_special_tokens=False).ids, encoder.b.encode(t)
        whole = b"".join(encoder.a_bytes[i] for i in wa) == b"".join(encoder.b_bytes[i] for i in wb) == (" " + t).encode()
        assert (x, y) == ((wa, wb) if whole else ([], [])), repr(t)


@pytest.mark.parametrize("seed", range(40))
def test_cuts(seed):
    rnd = random.Random(seed)
    n_docs, starts, a, b, at = rnd.randrange(1, 6), [0], [], [], 0
    for _ in range(n_docs):
        size = rnd.randrange(0, 400)
        pa, pb = rnd.choice([(1, 1), (.5, .5), (.9, .02), (.02, .9), (0, 0)])
        a += [at + i for i in range(1, size) if rnd.random() < pa] + [at + size] * (size > 0)
        b += [at + i for i in range(1, size) if rnd.random() < pb] + [at + size] * (size > 0)
        at += size
        starts.append(len(a))
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    assert alignment.shared_cuts(a, b, np.array(starts)).tolist() == np.isin(a, b).tolist()


def test_cutless_and_one_sided_intervals_end():
    """No common end but the last, in a long interval; and common ends that
    all lie at its front."""
    n = 400_000
    a = np.append(np.arange(1, 2 * n, 2), 2 * n)
    assert alignment.shared_cuts(a, np.arange(2, 2 * n + 1, 2), np.array([0, len(a)])).nonzero()[0].tolist() == [n]
    b = np.append(np.arange(1, 4001), 2 * n)
    cut = alignment.shared_cuts(a, b, np.array([0, len(a)]))
    assert cut.sum() == 2001 and cut[:2000].all()


def test_links_of_a_large_group_by_parts(monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 100)
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 5, 300), rnd.integers(0, 4, 200)
    ag, bg = np.sort(rnd.integers(0, 7, 300)), np.sort(rnd.integers(0, 7, 200))
    doc, key, n = alignment.link_pairs(a, ag, b, bg, np.array([0, 0, 0, 1, 1, 2, 2]))
    want = Counter((int(np.array([0, 0, 0, 1, 1, 2, 2])[g]), (int(u) << alignment.SHIFT) | int(v))
                   for u, g in zip(a, ag) for v, k in zip(b, bg) if g == k)
    assert dict(zip(zip(doc.tolist(), key.tolist()), n.tolist())) == dict(want)


def test_chunks_are_cut_as_arrays():
    rnd = random.Random(5)
    for _ in range(400):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choices("a é\t\n\xa0　日\x1c\x85", k=rnd.randrange(9)))
                 for _ in range(rnd.randrange(6))]
        cut, sizes = alignment.chunks(texts)
        want = [alignment.CHUNK.split(" " + t) if t else [] for t in texts]
        assert cut.to_pylist() == [c for cs in want for c in cs] and sizes.tolist() == [len(cs) for cs in want]
