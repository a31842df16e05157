"""Runs (maximal periodic stretches) of word sequences by suffix trees.

For each document two suffix trees are built by Ukkonen's algorithm, of its
word sequence and of the reversed one. An Euler tour of a tree with a range
minimum over the string depths gives the longest common extension of two
places as the depth of their leaves' lowest common ancestor. A run's root is,
in one of the two orders of the words, the longest Lyndon word at its place;
that word ends before the next smaller suffix (in the other order: the next
greater one), which a stack finds from the leaves' order in the tour. Every
such word is a candidate: it is extended to the right with the one tree and to
the left with the other, and is a run if both reach over a whole period. This
finds every run with its smallest period, once for each of its roots.

Of a document only the stretches that can hold a run of the least length go
into the trees, each ended by a word of its own: a run of least length 12 and
two periods is covered by 6-word windows that occur in it twice, so words in no
repeated window are cut out, again and again until nothing changes. The cut
loses no run; texts without repetition need no tree.

Rows are independent and there is no shuffle; a lost task is simply run again.
Memory is that of one Arrow batch and, a document at a time, of its trees
(linear in the words of its repeated stretches).

Cases: a null text has no words; an empty or blank one too, and both have no
run (nulls) and the digests of the empty string; texts of any length are read
whole; equal runs of length take the smallest start, then period; equal rows
give equal results; a null id stays, and is not rewritten by
``planted_tail``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import parts
from roundlearn.session import ship_package

LEAST = 12                 # words of the shortest run that is reported
GRAM = LEAST // 2          # words of the windows that cover a run twice
ROUNDS = 8                 # cuts of the stretches; more cuts only save work
PART_BYTES = 4 << 20       # texts of a batch that are numbered together


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (the split of bytes knows no other)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


# ---- suffix trees

class SuffixTree:
    """Ukkonen's tree of a sequence of small non-negative integers whose last
    one occurs nowhere else, with the Euler tour of its nodes."""

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        self._build(seq.tolist())
        self._tour(seq)

    def _build(self, s: list[int]) -> None:
        n, width = len(s), max(s) + 1
        start, end, link = [0], [0], [0]      # edge into a node: s[start:end]; leaves end at n
        child: dict[int, int] = {}            # node * width + first word of the edge
        node = edge = length = left = 0
        for i in range(n):
            left += 1
            w, last = s[i], 0
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    size = (end[to] if end[to] < i + 1 else i + 1) - start[to]
                    if length >= size:
                        edge += size
                        length -= size
                        node = to
                        continue
                    if s[start[to] + length] == w:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    mid = len(start)
                    start.append(start[to])
                    end.append(start[to] + length)
                    link.append(0)
                    child[key] = mid
                    child[mid * width + w] = mid + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    start[to] += length
                    child[mid * width + s[start[to]]] = to
                    if last:
                        link[last] = mid
                    last = mid
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self.start, self.end = start, end
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.kids = np.fromiter(child.values(), np.int64, len(child))[order]
        self.first = np.searchsorted(keys[order] // width, np.arange(len(start) + 1))

    def _tour(self, seq: np.ndarray) -> None:
        """String depths along the Euler tour; where each suffix's leaf
        stands in it, and the suffixes in the order of their leaves."""
        n, start, end = self.n, self.start, self.end
        kids, first = self.kids.tolist(), self.first.tolist()
        depths, leaf_at, order = [0], [0] * n, []
        path, depth, at = [0], [0], [first[0]]
        while path:
            node, k = path[-1], at[-1]
            if k == first[node + 1]:
                path.pop(), depth.pop(), at.pop()
                if depth:
                    depths.append(depth[-1])
                continue
            at[-1] += 1
            to = kids[k]
            d = depth[-1] + end[to] - start[to]
            if end[to] == n:
                suffix = n - d
                leaf_at[suffix] = len(depths)
                order.append(suffix)
                depths.append(d)
                depths.append(depth[-1])
            else:
                depths.append(d)
                path.append(to), depth.append(d), at.append(first[to])
        self.depths = np.array(depths, np.int32)
        self.leaf_at = np.array(leaf_at, np.int64)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extensions of the suffixes at ``a`` and ``b`` (0 past the
        end; ``a`` and ``b`` differ). Queries go level by level of the sparse
        table, of which one level is held at a time."""
        out = np.zeros(len(a), np.int64)
        ok = np.flatnonzero((a >= 0) & (b >= 0) & (a < self.n) & (b < self.n))
        x, y = self.leaf_at[a[ok]], self.leaf_at[b[ok]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((y - x + 1).astype(np.float64))[1] - 1
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange(level.max(initial=0) + 2))
        row = self.depths
        for k in range(len(cuts) - 1):
            if k:
                half = 1 << (k - 1)
                row = np.minimum(row[:-half], row[half:])
            q = by_level[cuts[k]:cuts[k + 1]]
            out[ok[q]] = np.minimum(row[x[q]], row[y[q] - (1 << k) + 1])
        return out


def _next(rank: list[int], greater: bool) -> np.ndarray:
    """For each place the next one whose suffix is smaller (or greater)."""
    n, out, stack = len(rank), [0] * len(rank), []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and (rank[stack[-1]] < r) == greater:
            stack.pop()
        out[i] = stack[-1] if stack else n
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(seq: np.ndarray, least: int = 2) -> np.ndarray:
    """All runs of at least ``least`` words and two periods of a sequence of
    integers: rows (start, length, period) by start, then period."""
    if len(seq) < 2:
        return np.empty((0, 3), np.int64)
    _, ids = np.unique(seq, return_inverse=True)
    n, end = len(ids), ids.max() + 1
    there = SuffixTree(np.append(ids, end))
    rank = there.rank[:n].tolist()
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([_next(rank, False), _next(rank, True)])
    i, j = i[j < n], j[j < n]
    right = there.lce(i, j)
    del there
    back = SuffixTree(np.append(ids[::-1], end))
    left = back.lce(n - i, n - j)             # of the words before i and before j, read backwards
    p = j - i
    good = (left + right >= p) & (p + left + right >= least)
    found = np.stack([i - left, p, p + left + right], 1)[good]
    return np.unique(found, axis=0)[:, [0, 2, 1]]


# ---- what of a batch can hold runs

def covered(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in stretches that can hold a run of ``LEAST``
    words, and the stretches' numbers. A word stays if it lies in a window of
    ``GRAM`` words that occurs twice in its stretch (at first: its document).
    Windows are compared by hash; equal hashes of different ones, or ending
    after ``ROUNDS``, only keep more."""
    place, seg = np.arange(len(ids)), doc.astype(np.int64)
    for _ in range(ROUNDS):
        m = len(place) - GRAM + 1
        if m < 1:
            return place[:0], seg[:0]
        w = ids[place].astype(np.uint64)
        h = seg[:m].astype(np.uint64)
        for k in range(GRAM):
            h = (h ^ w[k:k + m]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        at = np.flatnonzero(seg[:m] == seg[GRAM - 1:])
        order = np.argsort(h[at], kind="stable")
        same = h[at[order[1:]]] == h[at[order[:-1]]]
        hit = at[order[np.append(same, False) | np.append(False, same)]] if len(at) else at
        step = np.zeros(len(place) + 1, np.int64)
        step[hit] += 1                        # each place once
        np.add.at(step, hit + GRAM, -1)
        inside = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        cut = (np.diff(inside) != 1) | (np.diff(seg[inside]) != 0)
        number = np.cumsum(np.append(False, cut))[:len(inside)]
        long = np.bincount(number, minlength=1)[number] >= LEAST
        inside, number = inside[long], number[long]
        same_as_before = len(inside) == len(place)
        place, seg = place[inside], number
        if same_as_before:
            break
    return place, seg


def runs_of_documents(ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray | None]:
    """Runs of ``LEAST`` words and more of each document of a batch, whose
    words are ``ids[starts[d]:starts[d + 1]]``; None for none."""
    n = len(starts) - 1
    out: list[np.ndarray | None] = [None] * n
    doc = np.repeat(np.arange(n), np.diff(starts))
    place, seg = covered(ids, doc)
    bounds = np.searchsorted(place, starts)
    top = int(ids.max(initial=0)) + 1
    for d in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[d], bounds[d + 1]
        own, part = place[a:b], seg[a:b] - seg[a]
        seq = np.empty(b - a + part[-1], np.int64)
        seq[:] = -1
        back = np.zeros(len(seq), np.int64)
        at = np.arange(b - a) + part
        seq[at], back[at] = ids[own], own - starts[d]
        gap = np.flatnonzero(seq < 0)
        seq[gap] = top + np.arange(len(gap))  # each stretch ends by a word of its own
        found = runs_of(seq, LEAST)
        if len(found):
            found[:, 0] = back[found[:, 0]]
            out[d] = found
    return out


def planted_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The rewriting of the contract: of one document in ten, by the crc32
    of its id, the words from a place on repeat a period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


def collapse(words: list[bytes], runs: np.ndarray | None) -> bytes:
    """The words joined by one space, without those that a run holds after
    its first period."""
    if runs is None:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) of each document: its runs by start,
    then period, and its words with each run kept for one period.
    ``rewrite`` maps (id, words) to the words that are looked at."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def some(ids: list, texts: list) -> list[tuple]:
        words = [words_of(t) for t in texts]
        if rewrite is not None:
            words = [rewrite(i, w) for i, w in zip(ids, words)]
        flat, _ = pd.factorize(np.fromiter((w for ws in words for w in ws), object))
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        found = runs_of_documents(flat, starts)
        return [(len(w), [] if r is None else [{"start": s, "length": n, "period": p} for s, n, p in r.tolist()],
                 collapse(w, r).decode("utf-8", "surrogatepass")) for w, r in zip(words, found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in parts(b.column("text"), PART_BYTES):
                n, runs, kept = zip(*some(b.column("id")[p].to_pylist(), b.column("text")[p].to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("id")[p], pa.array(n, pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.string())],
                                                 ["id", "n_words", "runs", "collapsed"])
    ship_package(docs.sparkSession)
    id_type = src.schema["id"].dataType.simpleString()
    found = src.mapInArrow(run, f"id {id_type}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
                               "collapsed string")
    return found.withColumnRenamed("id", id_col)


def runs_digest(docs: DataFrame, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, number of runs, the greatest one, and the digests of all runs
    and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return find_runs(docs, rewrite=rewrite).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
