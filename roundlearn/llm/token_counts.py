"""Token counts under a unigram model, over a trie of distinct pretokens.

The best segmentation of a pretoken maximises the sum of its pieces' log
probabilities (fewest pieces on ties). The distinct pretokens of a batch are
walked as a trie: in byte order, each shares its longest common prefix with
the one before, whose forward scores, counts and open vocabulary matches are
kept; only the bytes past that prefix are computed. The count and score at a
pretoken's end are stored and added up over each text.

Probabilities follow from the ranks of a byte-level vocabulary file by Zipf's
law, p(rank) ~ 1 / (rank + 2.7); no model is trained.

Cases: null and empty texts have no tokens and score 0; any byte is a piece, so
any text has a count; texts and words of any length are counted whole; equal
rows get equal counts; null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import IntMap
from roundlearn.llm.subword import portions
from roundlearn.session import ship_package

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRETOKEN = re.compile(rb" ?[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+")
CACHED = 600_000           # pretokens that a worker remembers
SHORT = 32                 # bytes


def load_scores(ranks: str = RANKS) -> dict[bytes, float]:
    """Log probability of each piece of a file of base64 pieces and ranks."""
    with open(ranks, "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    total = math.fsum(1 / (r + 2.7) for r in found.values())
    return {p: -math.log((r + 2.7) * total) for p, r in found.items()}


class Counter:
    """Forward scores over the trie of pretokens."""

    def __init__(self, scores: dict[bytes, float]):
        if any(bytes([b]) not in scores for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.step: dict[int, int] = {}             # vocabulary trie: node * 256 + byte -> node
        self.score: list[float | None] = [None]
        for piece, s in scores.items():
            node = 0
            for c in piece:
                nxt = self.step.get(node << 8 | c)
                if nxt is None:
                    nxt = self.step[node << 8 | c] = len(self.score)
                    self.score.append(None)
                node = nxt
            self.score[node] = s
        self.table = IntMap(np.array(list(self.step), np.int64), np.array(list(self.step.values()), np.int64))
        self.scores = np.array([-math.inf if x is None else x for x in self.score])
        self.forget()

    def count(self, pretokens: list[bytes]) -> dict[bytes, tuple[int, float]]:
        """(tokens, log probability) of sorted distinct pretokens: short ones
        as arrays, a level of the trie at a time; long ones path by path."""
        short = [w for w in pretokens if len(w) <= SHORT]
        out: dict[bytes, tuple[int, float]] = {}
        for i in range(0, len(short), 10_000):
            out |= self.by_level(short[i:i + 10_000])
        return out | self.walk([w for w in pretokens if len(w) > SHORT])

    def by_level(self, pretokens: list[bytes]) -> dict[bytes, tuple[int, float]]:
        rows = len(pretokens)
        lens = np.array([len(w) for w in pretokens])
        width = int(lens.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in pretokens), np.uint8).reshape(rows, width)
        same = np.cumprod(text[1:] == text[:-1], 1).sum(1) if rows > 1 else np.empty(0, np.int64)
        shared = np.concatenate([[0], np.minimum(same, np.minimum(lens[1:], lens[:-1]))])
        best = np.zeros((width + 1, rows))          # by depth and row; a row stands for the
        count = np.zeros((width + 1, rows), np.int64)       # prefix of the first row that has it
        head = np.zeros((width + 1, rows), np.int64)        # that first row
        o_row, o_start, o_node = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        ids = np.arange(rows)
        for d in range(width):
            fresh = (shared <= d) & (lens > d)
            head[d + 1] = np.maximum.accumulate(np.where(fresh, ids, 0))
            child = ids[fresh]
            parent = head[d][child]
            # the open matches of each child's parent, grouped by parent row
            lo, hi = np.searchsorted(o_row, parent), np.searchsorted(o_row, parent, side="right")
            n = hi - lo
            which = np.repeat(np.arange(len(child)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            ok, node = self.table.get((o_node[at] << 8) | text[child[which], d])
            which, at, node = which[ok], at[ok], node[ok]
            start = o_start[at]
            r = head[start, child[which]]
            s = best[start, r] + self.scores[node]
            c = count[start, r] + 1
            group = np.searchsorted(which, np.arange(len(child)))     # each child has its last byte's match
            top = np.maximum.reduceat(s, group)
            least = np.minimum.reduceat(np.where(s == top[which], c, 1 << 60), group)
            best[d + 1, child], count[d + 1, child] = top, least
            order = np.argsort(np.concatenate([which, np.arange(len(child))]), kind="stable")
            o_row = np.concatenate([child[which], child])[order]
            o_start = np.concatenate([start, np.full(len(child), d + 1)])[order]
            o_node = np.concatenate([node, np.zeros(len(child), np.int64)])[order]
        last = head[lens, ids]
        return dict(zip(pretokens, zip(count[lens, last].tolist(), best[lens, last].tolist(), strict=True), strict=True))

    def walk(self, pretokens: list[bytes]) -> dict[bytes, tuple[int, float]]:
        out = {}
        step, score = self.step, self.score
        best, count = [0.0], [0]                   # by depth on the present path
        open_at: list[list[tuple[int, int]]] = [[(0, 0)]]      # (start, vocabulary node) that may go on
        last = b""
        for w in pretokens:
            depth, most = 0, min(len(w), len(last))
            while depth < most and w[depth] == last[depth]:
                depth += 1
            del best[depth + 1:], count[depth + 1:], open_at[depth + 1:]
            for j in range(depth, len(w)):
                c = w[j]
                top, least, live = -math.inf, 0, []
                for i, node in open_at[j]:
                    nxt = step.get(node << 8 | c)
                    if nxt is not None:
                        live.append((i, nxt))
                        s = score[nxt]
                        if s is not None:
                            s += best[i]
                            n = count[i] + 1
                            if s > top or s == top and n < least:
                                top, least = s, n
                live.append((j + 1, 0))
                best.append(top)
                count.append(least)
                open_at.append(live)
            out[w] = (count[-1], best[-1])
            last = w
        return out

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}          # pretoken -> place in the two lists
        self.n_tokens, self.log_prob = np.zeros(0, np.int64), np.zeros(0)

    def learn(self, pretokens: set[bytes]) -> None:
        found = self.count(sorted(pretokens))
        base = len(self.known)
        self.known.update(zip(found, range(base, base + len(found))))
        n, s = zip(*found.values(), strict=True)
        self.n_tokens = np.concatenate([self.n_tokens, np.array(n, np.int64)])
        self.log_prob = np.concatenate([self.log_prob, np.array(s)])

    def totals(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(pretokens, tokens, log probability) of each text."""
        cut = [PRETOKEN.findall(t.encode()) if t else [] for t in texts]
        sizes = np.array([len(c) for c in cut])
        words = [w for c in cut for w in c]
        if len(self.known) > CACHED:
            self.forget()
        get = self.known.get
        at = np.array([get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn({words[i] for i in new})
            at[new] = [self.known[words[i]] for i in new]
        ends = np.cumsum(sizes)
        n = np.concatenate([[0], np.cumsum(self.n_tokens[at])])
        out = []
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            out.append((b - a, int(n[b] - n[a]), float(np.sum(self.log_prob[at[a:b]]))))
        return out


_ready: dict[tuple, Counter] = {}


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, log_prob."""
    ship_package(df.sparkSession)
    scores = df.sparkSession.sparkContext.broadcast(load_scores(ranks))       # one vocabulary, some MB
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks, len(scores.value))
        if key not in _ready:
            _ready.clear()
            _ready[key] = Counter(scores.value)
        for b in batches:
            for p in portions(b, 1, 8_000_000):
                n, k, s = zip(*_ready[key].totals(p.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()),
                                                  pa.array(s, pa.float64())],
                                                 names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n_pretokens long, n_tokens long, log_prob double")
