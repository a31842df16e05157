"""Set similarity self-join of documents on word n-grams, made exact by a
partition of the universe of shingles.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. Sets of close sizes share a *size band* ``[2^k,
2.5 * 2^k]``; any two sets that can link lie in one band together. The band
cuts the universe of shingles by hash into segments of about three shingles of
its largest sets. A pair that links differs in at most ``D = (|r|+|s|) / 9``
shingles, so of any ``D + 1`` segments one is equal in both.

Allocation by cost. A segment gets the threshold 0 (not indexed), 1 (its
subset is indexed) or more (its deletion neighbourhood is indexed as well):

* empty segments cost most (all sets share them) and always get 0;
* shingles held by many documents (shared passages) form *hot* segments of
  their own behind all others, which get 0 as long as the others suffice. How
  often a shingle is held is estimated from one distinct set in ``SAMPLE``: any
  choice of hot shingles gives the same links, it only moves cost, and this one
  is alike at every size, so groups of cold segments stay small as data grow.

Each set climbs a ladder until its thresholds add up to D + 1:

1. threshold 1 for its first D + 1 non-empty cold segments;
2. thresholds up to 2 (subset and one-deletion neighbourhood) for all cold
   segments, then up to 3 and 4 (two and three deletions);
3. in addition, threshold 1 for its first non-empty hot segments;
4. deletions in all segments, as deep as it takes.

What a set indexes on one step holds all that a set on a lower step asks of its
partner, so the lower of the two finds the pair; on steps 1 and 3 the set whose
prefix of segments is shorter does.

Documents with the same set are one *node*. Nodes with a signature in common
are tested in steps: each node with the hubs (a few nodes of each group, mostly
the same over groups) it shares most signatures with; then, since linked nodes need no further
links between them, only pairs of one group that lie in different components so
far. Sizes and parity bitmaps, whose distance never exceeds that of the sets,
rule most false pairs out; the rest are verified on whole texts, each node's
nearest pairs with another component first, then all others of the two that
these have not joined. So a
group of many near copies costs a few verifications for each member. In a group
of several components the bitmaps are compared inside of tiles of at most about
``TILE`` nodes a side, in whatever task holds the tile; only pairs that may
link leave it, so no group is expanded into rows for its pairs.

Sets are sets of 64-bit hashes of the shingles (all word bytes count); two
different shingles of one pair of documents meet with odds below 1e-12.

Cases: null or empty texts and texts without words have an empty set, link
with nothing and are their own component; fewer than five words form one
shingle; a null id is kept, and a component's id is the smallest non-null id
(null if there is none); repeated rows are copies like any other; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundlearn.llm.common import free_name, parts, written
from roundlearn.llm.components import components

WORDS = 5
SIM_NUM, SIM_DEN = 80, 100            # link: SIM_DEN * intersection >= SIM_NUM * union
HOT_DOCS = 48                         # a shingle of fewer sets (by the estimate) is not hot
SAMPLE = 16                           # one set in so many is counted for that estimate
HOT_MAX = 1 << 24                     # at most so many shingles are marked in the broadcast bitmap
TILE = 2_048                          # nodes of a side of a tile
ORDERS = 4                            # hubs of a group; a node is tested with twice as many
FIRST = 3                             # pairs of a node with a component that are tested before its others
DEEPEST = 3                           # deletions in cold segments before hot ones are used
MAP_BITS = 26                         # size of the bitmaps of wanted nodes and of hot shingles (8 MB)

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_IS_WORD = np.array([c not in (9, 10, 11, 12, 13, 32) for c in range(256)])
_BYTE[~_IS_WORD] = 0
_PLACE = mix(np.arange(1, WORDS + 1, dtype=_U)) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_starts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of lower-cased bytes."""
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = _IS_WORD[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * up[:len(b)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def _places(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U)) | _U(1)


def _joint_sets(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and how
    many each text has."""
    begin = np.cumsum([0, *(len(x) + 1 for x in raw[:-1])])
    starts, w = word_starts(np.frombuffer(b"\n".join(raw).translate(_LOWER), np.uint8))
    if not len(w):
        return w, np.zeros(len(raw), np.int64)
    doc = np.searchsorted(begin, starts, side="right") - 1
    places = _places(n)
    parts, owners = [], []
    if len(w) >= n:
        whole = doc[:len(w) - n + 1] == doc[n - 1:]
        total = np.full(len(w) - n + 1, n, _U)
        for j in range(n):
            total += w[j:len(w) - n + 1 + j] * places[j]
        parts.append(mix(total[whole]))
        owners.append(doc[:len(w) - n + 1][whole])
    n_words = np.bincount(doc, minlength=len(raw))
    short = np.flatnonzero((n_words > 0) & (n_words < n))
    if len(short):
        at = np.searchsorted(doc, short)
        one = [np.sum(w[i:i + n_words[d]] * places[:n_words[d]], dtype=_U) + _U(n_words[d]) for i, d in zip(at, short, strict=True)]
        parts.append(mix(np.array(one, _U)))
        owners.append(short)
    values, owner = np.concatenate(parts), np.concatenate(owners)
    if len(short):
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(raw)))
    at = 0
    for e in ends.tolist():
        values[at:e].sort()
        at = e
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.bincount(owner[fresh], minlength=len(raw))


def sets_of(texts: list[str | None], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``_joint_sets`` of any number of texts, some megabytes at a time."""
    values, counts, group, size = [], [], [], 0
    for i, t in enumerate(texts):
        raw = t.encode() if t else b""
        group.append(raw)
        size += len(raw)
        if size > 2_000_000 or i == len(texts) - 1:
            v, c = _joint_sets(group, n)
            values.append(v)
            counts.append(c)
            group, size = [], 0
    return (np.concatenate(values), np.concatenate(counts)) if values else (np.empty(0, _U), np.zeros(0, np.int64))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of one text's word n-grams."""
    return sets_of([text], n)[0]


_SALTS = mix(np.arange(101, 111, dtype=_U))


def nodes_of(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """For each set its 64-bit key and 128-bit fingerprint (empty: 0, none)."""
    keys = np.zeros(len(counts), np.int64)
    fps: list[bytes | None] = [None] * len(counts)
    full = np.flatnonzero(counts)
    if len(full):
        first = (np.cumsum(counts) - counts)[full]
        one = np.add.reduceat(mix(values ^ _SALTS[0]), first)
        two = np.add.reduceat(mix(values ^ _SALTS[1]), first)
        keys[full] = mix(one).view(np.int64)
        both = np.stack([one, two], 1).astype(">u8").tobytes()
        for i, d in enumerate(full.tolist()):
            fps[d] = both[16 * i:16 * i + 16]
    return keys, fps


def bitmap_bits(size: int) -> int:
    """Bits of a set's bitmap, a power of two: four times its size up to
    4 096, its size beyond, 64 at least. For sets that can link they are the
    same or differ by a factor of 2."""
    up = 1 << (size - 1).bit_length()
    return max(64, up, min(4 * up, 4_096))


def bitmaps_of(values: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A parity bitmap for each set: bit j tells whether an odd number of its
    shingles hash to j. Two bitmaps differ in no more bits than their sets
    differ in shingles; a bitmap folds to half its size by xor."""
    out: list[bytes | None] = [None] * len(counts)
    place = mix(values ^ _SALTS[5]) >> _U(8)
    at = 0
    for i, n in enumerate(counts.tolist()):
        if n:
            bits = bitmap_bits(n)
            odd = np.bincount((place[at:at + n] & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
            out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
        at += n
    return out


def slack(na: int, a: bytes, nb: int, b: bytes) -> int:
    """By how much two bitmaps are nearer than sets that link may be apart; a
    negative number proves that the sets do not link."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return (SIM_DEN - SIM_NUM) * (na + nb) - (SIM_DEN + SIM_NUM) * int(np.bitwise_count(x ^ y).sum())


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test of two sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and SIM_DEN * both >= SIM_NUM * (len(a) + len(b) - both)


def bands(size: int) -> list[int]:
    """The bands k with 2^k <= size <= 2.5 * 2^k."""
    k = size.bit_length() - 1
    return [k] if k == 0 or 2 * size > 5 << (k - 1) else [k - 1, k]


def most_apart(size: int, top: int) -> int:
    """Most shingles in which a set of ``size`` and a partner in a band up to
    ``top`` can differ if they link."""
    partner = min(top, size * SIM_DEN // SIM_NUM)
    return (size + partner) * (SIM_DEN - SIM_NUM) // (SIM_DEN + SIM_NUM)


def _segments(top: int) -> int:
    """Segments of a band's universe: about three shingles of its largest
    sets, and one more than its largest pairs can differ in."""
    return max(-(-top // 3), most_apart(top, top) + 1)


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the low bits of each key are set in a bitmap."""
    low = keys & ((1 << MAP_BITS) - 1)
    return (bitmap[low >> 6] >> (low & 63)) & 1 == 1


def signatures(values: np.ndarray, counts: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of many sets (end to end) and the set each belongs to.
    ``hot``: bitmap of the hashes whose segments come last (empty: none)."""
    sets = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)
    out_sig, out_set = [np.empty(0, _U)], [np.empty(0, np.int64)]
    jobs: dict[int, list[int]] = {}
    for d in sets.tolist():
        for k in bands(int(counts[d])):
            jobs.setdefault(k, []).append(d)
    for k, docs in jobs.items():
        top = (5 << k) // 2
        m = _segments(top)
        docs_a = np.array(docs)
        lens = counts[docs_a]
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(first[docs_a].tolist(), lens.tolist(), strict=True)])
        s, own = values[at], np.repeat(np.arange(len(docs)), lens)
        seg = ((mix(s ^ _SALTS[3]) >> _U(8)) % _U(m)).astype(np.int64)
        if len(hot):
            seg[marked(hot, s.view(np.int64))] += m
        order = np.argsort(own * (2 * m) + seg)
        element, seg, own = mix(s ^ _SALTS[2])[order], seg[order], own[order]
        start = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (own[1:] != own[:-1])]))
        sums = np.add.reduceat(element, start)
        tag = mix(seg[start].astype(_U) ^ (_SALTS[4] + np.full(1, k, _U)))
        g_own, is_hot = own[start], seg[start] >= m
        n_groups = np.bincount(g_own, minlength=len(docs))
        n_cold = np.bincount(g_own[~is_hot], minlength=len(docs))
        g_first = np.cumsum(n_groups) - n_groups
        need = (lens + np.minimum(top, lens * SIM_DEN // SIM_NUM)) * (SIM_DEN - SIM_NUM) // (SIM_DEN + SIM_NUM) + 1
        plain = n_cold >= need
        take = plain[g_own] & (np.arange(len(start)) - g_first[g_own] < need[g_own])
        out_sig.append(mix(sums[take] ^ tag[take]))
        out_set.append(docs_a[g_own[take]])
        sizes = np.diff(start, append=len(element))
        for j in np.flatnonzero(~plain).tolist():
            g = slice(g_first[j], g_first[j] + n_groups[j])
            x = _neighbourhoods(element, start[g], sizes[g], sums[g], tag[g], int(n_cold[j]), int(need[j]))
            out_sig.append(x)
            out_set.append(np.full(len(x), docs_a[j]))
    return np.concatenate(out_sig).view(np.int64), np.concatenate(out_set)


def _neighbourhoods(element, start, sizes, sums, tag, cold: int, need: int) -> np.ndarray:
    """Signatures of a set whose first ``cold`` segments, those without hot
    shingles, are fewer than it needs: the higher steps of the ladder."""
    deep, used = 1, cold
    while deep < DEEPEST and int(np.minimum(sizes[:cold], 1 + deep).sum()) < need:
        deep += 1
    total = int(np.minimum(sizes[:cold], 1 + deep).sum())
    if total < need:                                        # hot segments, as few as needed
        used = min(cold + need - total, len(sizes))
        total += used - cold
    while total < need:                                     # deletions in all segments
        deep += 1
        total = int(np.minimum(sizes, 1 + deep).sum())
        cold = len(sizes)
    out = [mix(sums[:used] ^ tag[:used])]
    for i in np.flatnonzero(sizes[:cold] > 1).tolist():
        part = element[start[i]:start[i] + sizes[i]]
        out.append(mix((sums[i:i + 1] - part) ^ tag[i]))
        for d in range(2, min(deep, int(sizes[i]) - 1) + 1):
            gone = np.array([sum(int(x) for x in c) & ((1 << 64) - 1) for c in combinations(part, d)], _U)
            out.append(mix((sums[i:i + 1] - gone) ^ tag[i]))
    return np.unique(np.concatenate(out))


def _split(joint: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    return np.split(joint[0], np.cumsum(joint[1])[:-1])


def _slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, some megabytes of texts at a time."""
    for b in batches:
        for p in parts(b.column(1), size):
            yield b.column(0)[p], b.column(1)[p].to_pylist()


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _survey(src: DataFrame, words: int) -> DataFrame:
    """One pass over the texts. Rows with n: a document's size, key,
    fingerprint and bitmap; rows with hot: a shingle and how many different
    sampled sets of one stretch of rows hold it."""
    stretch = 4_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        total = 0

        def counted() -> tuple[list, list]:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return h.view(np.int64), c.astype(np.int64)

        for ids, texts in _slices(batches):
            values, counts = sets_of(texts, words)
            keys, fps = nodes_of(values, counts)
            ends = np.cumsum(counts)
            yield _survey_batch(ids, counts, keys, fps, bitmaps_of(values, counts), None, None)
            for i in np.flatnonzero((counts > 0) & (keys % SAMPLE == 0)).tolist():
                if fps[i] not in seen:
                    seen.add(fps[i])
                    held.append(values[ends[i] - counts[i]:ends[i]])
                    total += int(counts[i])
                if total >= stretch:
                    h, c = counted()
                    yield _survey_batch(pa.nulls(len(h), src_type), None, None, None, None, h, c)
                    seen, held, total = set(), [], 0
        if held:
            h, c = counted()
            yield _survey_batch(pa.nulls(len(h), src_type), None, None, None, None, h, c)

    from pyspark.sql.pandas.types import to_arrow_type
    src_type = to_arrow_type(src.schema["doc_id"].dataType)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n long, k long, fp binary, bits binary, hot long, docs long")


def _survey_batch(ids, n, keys, fps, bits, hot, cnt) -> pa.RecordBatch:
    size = len(ids)
    col = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(x, kind)
    return pa.RecordBatch.from_arrays(
        [ids, col(n, pa.int64()), col(keys, pa.int64()), col(fps, pa.binary()), col(bits, pa.binary()), col(hot, pa.int64()),
         col(cnt, pa.int64())], names=["doc_id", "n", "k", "fp", "bits", "hot", "docs"])


def _hot(survey: DataFrame) -> np.ndarray:
    """Bitmap of the most frequent shingles, at most HOT_MAX: those above the
    smallest power of two of sets that leaves no more."""
    counts = (survey.where("hot is not null").groupBy("hot").agg(F.sum("docs").alias("docs"))
              .where(F.col("docs") * SAMPLE >= HOT_DOCS))
    counts = written(counts, "hot-shingles")
    classes = counts.groupBy(F.floor(F.log2("docs")).alias("c")).count().orderBy(F.desc("c")).collect()   # under 64 rows
    total, least = 0, None
    for r in classes:
        total += r["count"]
        if total > HOT_MAX:
            break
        least = r["c"]
    if least is None:
        return np.empty(0, np.int64)
    return key_bitmap(counts.where(F.floor(F.log2("docs")) >= least).select(F.col("hot").alias("k")))


def _signature_rows(src: DataFrame, hot, words: int) -> DataFrame:
    """(signature, key of the node), for copies in one stretch of rows once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches):
            values, counts = sets_of(texts, words)
            keys, fps = nodes_of(values, counts)
            later = np.ones(len(fps), bool)
            later[list({fp: j for j, fp in reversed(list(enumerate(fps)))}.values())] = False
            values, counts = values[~np.repeat(later, counts)], np.where(later, 0, counts)
            sig, own = signatures(values, counts, hot.value)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(keys[own])], names=["sig", "k"])
    return src.mapInArrow(run, "sig long, k long")


def _members(src: DataFrame, hot, words: int) -> DataFrame:
    """(sig, k) of the signatures that two nodes or more have, written. The
    frames of the signatures, whose two shuffles are the largest of the join,
    live no longer than this call, so Spark can drop those files after it."""
    sigs = _signature_rows(src, hot, words)
    shared = sigs.groupBy("sig").agg(F.min("k").alias("hub"), F.max("k").alias("top")).where("hub <> top")
    return written(sigs.join(shared.select("sig"), "sig").distinct(), "members")


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the low bits of keys ``k``: a filter
    that lets some others pass, never one too few."""
    low = F.col("k").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    cells = keys.select(F.shiftright(low, 6).alias("cell"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    t = cells.groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[t.column(0).to_numpy()] = t.column(1).to_numpy()
    return out


def _texts(src: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(fp, text) of the nodes with wanted keys (and a few more), each once."""
    bitmap = src.sparkSession.sparkContext.broadcast(key_bitmap(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in _slices(batches):
            keys, fps = nodes_of(*sets_of(texts, words))
            out = []
            for i in np.flatnonzero(marked(bitmap.value, keys)).tolist():
                if fps[i] is not None and fps[i] not in seen:
                    seen.add(fps[i])
                    out.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([fps[i] for i in out], pa.binary()),
                                                  pa.array([texts[i] for i in out], pa.string())], names=["fp", "text"])
    rows = src.mapInArrow(run, "fp binary, text string")
    return written(rows.groupBy("fp").agg(F.first("text").alias("text")), "node-texts")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs``: columns k, hub (keys). Returns those whose sizes and bitmaps
    allow a link, with their fingerprints and slack: (k, hub, a, b, slack)."""
    one = nodes.select("k", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    two = nodes.select(F.col("k").alias("hub"), F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    close = SIM_DEN * F.least("na", "nb") >= SIM_NUM * F.greatest("na", "nb")
    rows = (pairs.join(one, "k").join(two, "hub").where(close)
            .select("k", "hub", "a", "b", "na", "bits_a", "nb", "bits_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            left = np.array([slack(*r) for r in zip(*(x.column(i).to_pylist() for i in range(4, 8)), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array(left)], names=[*x.schema.names[:4], "slack"]).filter(
                pa.array(left >= 0))
    return written(rows.mapInArrow(run, "k long, hub long, a binary, b binary, slack long"), "candidates")


def _verify(full: DataFrame, src: DataFrame, words: int) -> DataFrame:
    """``full``: pairs (k, hub, a, b). Returns those that link, as (a, b),
    tested on whole texts."""
    texts = _texts(src, full.select("k").union(full.select("hub")).distinct(), words)
    # a hub of many partners is dealt out over slices, its text once to each
    fan = full.groupBy("b").count().select("b", F.ceil(F.col("count") / 512).cast("int").alias("slices"))
    fan = written(fan.where("slices > 1"), "hubs")
    sliced = full.join(fan, "b", "left").select(
        "a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("slices")).cast("int"), F.lit(0)).alias("slice"))
    left = sliced.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")
    right = (texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")).join(fan, "b", "left")
             .select("b", "tb", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice")))
    rows = left.join(right, ["b", "slice"]).select("a", "ta", "b", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 2_000):
                y = x.slice(i, 2_000)
                hubs = y.column(2).to_pylist()
                place = {b: j for j, b in enumerate(dict.fromkeys(hubs))}
                hub_text = dict(zip(hubs, y.column(3).to_pylist(), strict=True))
                left, right = _split(sets_of(y.column(1).to_pylist(), words)), _split(sets_of([hub_text[b] for b in place], words))
                ok = [links(s, right[place[b]]) for s, b in zip(left, hubs, strict=True)]
                yield y.select([0, 2]).filter(pa.array(ok, pa.bool_()))
    return written(rows.mapInArrow(run, "a binary, b binary").distinct(), "links")


def _stars(members: DataFrame) -> DataFrame:
    """(k, hub): for each node the hubs it shares most signatures with. A
    group has a hub in each of some orders of all keys (the smallest key after
    an exclusive or with a constant), so groups with common members mostly
    have the same hubs."""
    turns = [int(x) for x in mix(np.arange(7, 7 + ORDERS, dtype=_U)).view(np.int64)]
    turned = [F.col("k").bitwiseXOR(F.lit(t)) for t in turns]
    hubs = members.groupBy("sig").agg(*[F.min(x).alias(f"h{i}") for i, x in enumerate(turned)])
    each = F.explode(F.array_distinct(F.array(*[F.col(f"h{i}").bitwiseXOR(F.lit(t)) for i, t in enumerate(turns)])))
    pairs = members.join(hubs.select("sig", each.alias("hub")), "sig").where("k <> hub")
    order = Window.partitionBy("k").orderBy(F.desc("count"), "hub")
    return (pairs.groupBy("k", "hub").count().withColumn("r", F.row_number().over(order))
            .where(F.col("r") <= 2 * ORDERS).select("k", "hub"))


def _root_keys(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k, c): key of each linked node and of its component's root."""
    keys = nodes.select("fp", "k")
    return (roots.join(keys.select(F.col("fp").alias("root"), F.col("k").alias("c")), "root")
            .join(keys.withColumnRenamed("fp", "node"), "node").select("k", "c"))


def _halved(x: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of words) folded to half their size."""
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:] if half else x


def tile_pairs(group: np.ndarray, k: np.ndarray, c: np.ndarray, big: np.ndarray, role: np.ndarray, n: np.ndarray,
               bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of one group, i of role 1, j of role 2, in different
    components, whose sizes and bitmaps allow a link, with their slack.
    ``group`` is increasing; pairs are looked at a million at a time."""
    left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    size = np.array([len(x) // 8 for x in bits])
    at = np.zeros(len(bits), np.int64)        # a row's place among those of its bitmap's size
    rows: dict[int, np.ndarray] = {}
    for w in np.unique(size).tolist():
        own = np.flatnonzero(size == w)
        at[own] = np.arange(len(own))
        rows[w] = np.frombuffer(b"".join(bits[i] for i in own.tolist()), _U).reshape(len(own), w)
    first = np.searchsorted(group[right], group[left])
    many = np.searchsorted(group[right], group[left], "right") - first
    total, a, out = np.cumsum(many), 0, []
    while a < len(left):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 20), "right")))
        m = many[a:z]
        i = np.repeat(left[a:z], m)
        j = right[np.repeat(first[a:z], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        a = z
        lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (c[i] != c[j]) & ((c[j] == big[i]) | (k[i] < k[j])) & (SIM_DEN * lo >= SIM_NUM * hi)
        i, j = i[ok], j[ok]
        shift = np.abs(np.log2(size[i] / size[j])).astype(np.int64)
        apart = np.zeros(len(i), np.int64)
        for w in rows:
            for x, y, back in ((i, j, 0), (i, j, 1), (j, i, 1)):     # sizes alike; that of x twice that of y
                pick = np.flatnonzero((size[y] == w) & (shift == back) & (size[x] == w << back))
                for p in np.array_split(pick, 1 + len(pick) * w // (1 << 22)):
                    of_x = rows[w << back][at[x[p]]] if len(p) else np.zeros((0, w << back), _U)
                    apart[p] = np.bitwise_count((_halved(of_x) if back else of_x) ^ rows[w][at[y[p]]]).sum(1, dtype=np.int64)
        spare = (SIM_DEN - SIM_NUM) * (n[i] + n[j]) - (SIM_DEN + SIM_NUM) * apart
        good = spare >= 0
        out.append((i[good], j[good], spare[good]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_PAIR = "struct<k: bigint, hub: bigint, a: binary, b: binary, slack: bigint>"


def _pair_rows(k: np.ndarray, c: np.ndarray, fp: pa.Array, i: np.ndarray, j: np.ndarray, spare: np.ndarray) -> pa.RecordBatch:
    """One row for each node i and other component: a member of it and the
    pairs with its members, the ``FIRST`` nearest apart from the others."""
    order = np.lexsort((-spare, c[j], i))
    i, j, spare = i[order], j[order], spare[order]
    fresh = np.append(True, (i[1:] != i[:-1]) | (c[j][1:] != c[j][:-1]))[:len(i)]
    start = np.flatnonzero(fresh)
    place = np.arange(len(i)) - start[np.cumsum(fresh) - 1] if len(i) else i
    large, small = np.where(k[i] > k[j], i, j), np.where(k[i] > k[j], j, i)
    cols = [pa.array(k[large]), pa.array(k[small]), fp.take(pa.array(large)), fp.take(pa.array(small)), pa.array(spare)]
    lists = []
    for some in (place < FIRST, place >= FIRST):
        at = pa.array(np.flatnonzero(some))
        sizes = np.add.reduceat(some, start, dtype=np.int64) if len(i) else np.zeros(0, np.int64)
        items = pa.StructArray.from_arrays([x.take(at) for x in cols], names=["k", "hub", "a", "b", "slack"])
        lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), items))
    return pa.RecordBatch.from_arrays([fp.take(pa.array(i[start])), fp.take(pa.array(j[start])), *lists], names=["fa", "fb", "near", "rest"])


def _across(members: DataFrame, root_keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """For nodes that share a signature but no component, a row for each node
    and other component of a group: fa, fb (fingerprints of the node and of a
    member), near and rest (the pairs k, hub, a, b, slack whose sizes and
    bitmaps allow a link, nearest first). In each group all but the largest
    component's nodes meet the others, so a group within one component gives
    nothing. Groups are compared by tiles."""
    placed = written(members.join(root_keys, "k", "left").select("sig", "k", F.coalesce("c", "k").alias("c")), "placed")
    split = (placed.groupBy("sig", "c").count().groupBy("sig")
             .agg(F.max_by("c", F.struct("count", "c")).alias("big"), F.count(F.lit(1)).alias("parts"),
                  F.sum("count").alias("all"), F.max("count").alias("most")).where("parts > 1")
             .select("sig", "big", F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("rows"),
                     F.ceil(F.col("all") / TILE).cast("int").alias("cols")))
    rows = placed.join(split, "sig").join(nodes.select("k", "fp", "n", "bits"), "k")
    cell = lambda x, y, role: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), role.cast("int").alias("role"))
    h, zero, outside = F.xxhash64("k"), F.lit(0), F.col("c") != F.col("big")
    as_left = F.transform(F.sequence(zero, F.col("cols") - 1), lambda y: cell(F.pmod(h, F.col("rows")), y, F.lit(1)))
    as_right = F.transform(F.sequence(zero, F.col("rows") - 1), lambda x: cell(x, F.pmod(h, F.col("cols")), F.lit(2)))
    tiles = (F.when((F.col("rows") == 1) & (F.col("cols") == 1), F.array(cell(zero, zero, F.when(outside, 3).otherwise(2))))
             .when(outside, F.concat(as_left, as_right)).otherwise(as_right))
    dealt = (rows.withColumn("t", F.explode(tiles)).select("sig", "t.x", "t.y", "t.role", "k", "c", "big", "n", "fp", "bits")
             .repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y"))

    def compare(t: pa.Table) -> pa.RecordBatch:
        sig, x, y, role, k, c, big, n = (t.column(i).to_numpy() for i in range(8))
        fresh = (sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        i, j, spare = tile_pairs(np.append(0, np.cumsum(fresh)), k, c, big, role, n, t.column(9).to_pylist())
        return _pair_rows(k, c, t.column(8).combine_chunks(), i, j, spare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []       # rows whose tile may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            t = pa.Table.from_batches(kept)
            last = [t.column(i)[t.num_rows - 1] for i in range(3)]
            same = np.logical_and.reduce([t.column(i).to_numpy() == v.as_py() for i, v in enumerate(last)])
            end = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if end:
                yield compare(t.slice(0, end))
            kept = t.slice(end).combine_chunks().to_batches()
        if kept:
            yield compare(pa.Table.from_batches(kept))
    return written(dealt.mapInArrow(run, f"fa binary, fb binary, near array<{_PAIR}>, rest array<{_PAIR}>"), "across")


def _pairs_in(rows: DataFrame, column: str, without: DataFrame) -> DataFrame:
    """The distinct pairs of a list column, without those tested before."""
    pairs = rows.select(F.explode(column).alias("x")).select("x.*").distinct()
    return pairs.join(without, ["k", "hub"], "left_anti")


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows whose two nodes are not in one component."""
    one = roots.select(F.col("node").alias("fa"), F.col("root").alias("ra"))
    two = roots.select(F.col("node").alias("fb"), F.col("root").alias("rb"))
    return rows.join(one, "fa", "left").join(two, "fb", "left").where(F.coalesce("ra", "fa") != F.coalesce("rb", "fb"))


def join_nodes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS):
    """Returns (rows, groups): rows has (doc_id, n, k, fp) for each document;
    groups has (fp, component_id, rep_fp) for each distinct set."""
    src = _source(df, id_col, text_col)
    survey = written(_survey(src, words), "survey")
    rows = survey.where("n is not null").select("doc_id", "n", "k", "fp")
    nodes = written(survey.where("n > 0").groupBy("k", "fp").agg(
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("doc_id")), "nodes")
    hot = src.sparkSession.sparkContext.broadcast(_hot(survey))
    members = _members(src, hot, words)
    # first every node with the hubs it shares most signatures with
    stars = written(_stars(members), "stars")
    near = _verify(_possible(stars, nodes), src, words)
    roots = components(near)
    # then what lies in one group but not in one component: first the nearest
    # pairs of each node with each other component of a group, since one link
    # joins them; then, where that was not so, all pairs that the bitmaps allow
    across = _across(members, _root_keys(roots, nodes), nodes)
    first = written(_pairs_in(across, "near", stars), "candidates")
    near = written(near.union(_verify(first, src, words)), "links")
    roots = components(near)
    left = _open(across.where(F.size("rest") > 0), roots)
    rest = written(_pairs_in(left, "rest", stars).join(first, ["k", "hub"], "left_anti"), "open")
    if not rest.isEmpty():
        roots = components(near.union(_verify(rest, src, words)))
    placed_nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    best = placed_nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.when(
        F.col("doc_id").isNotNull(), F.struct("doc_id", "fp"))).alias("r"), F.min("fp").alias("any_fp"))
    groups = placed_nodes.join(best, "root").select("fp", "component_id", F.coalesce("r.fp", "any_fp").alias("rep_fp"))
    return rows, written(groups, "groups")


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, groups = join_nodes(df, id_col, text_col, words)
    got = rows.join(groups.select("fp", "component_id"), "fp", "left")
    return got.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One document of each component, that with the smallest id, with all its
    columns; documents without words all stay."""
    _, groups = join_nodes(df, id_col, text_col, words)
    names = {x: free_name(df.columns, x) for x in ("fp", "component_id", "rep_fp")}
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array(nodes_of(*sets_of(b.column(at).to_pylist(), words))[1], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, fps], names=[*b.schema.names, names["fp"]])
    marked = df.mapInArrow(run, df.select("*", F.lit(None).cast("binary").alias(names["fp"])).schema)
    own = [F.col(f"`{c}`") for c in df.columns]
    empty = marked.where(F.col(names["fp"]).isNull()).select(*own)
    heads = groups.where("fp = rep_fp").select(F.col("fp").alias("r_fp"), F.col("component_id").alias("r_id"))
    got = marked.join(heads, (F.col(names["fp"]) == F.col("r_fp")) & F.col(f"`{id_col}`").eqNullSafe(F.col("r_id")), "left_semi")
    return got.dropDuplicates([names["fp"]]).select(*own).unionByName(empty)
