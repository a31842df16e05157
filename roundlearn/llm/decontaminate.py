"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items go into one automaton whose states know the
items of their 13-word windows (an item of fewer words is one window). A
document's words are streamed through it; the length of the longest match that
ends at each word says which words lie inside a window and which items match.
Runs of words that no item has are passed over, since they reset the match.

The items are taken in blocks of a bounded number of words (``BLOCK_WORDS``).
One block is all that the driver and a task hold at a time: its items are
broadcast, every document is streamed against them, and where there are more
blocks, what they hit in each distinct text is written before the next block is
read; in the end the hits of all blocks are merged by text.

``keep_clean`` drops the contaminated documents and takes hit runs of
``max_run`` words or more out of the others; ``remove_spans`` keeps every
document without its runs over the length or coverage limit.

Cases: null and empty texts have no words; the windows of an item with a null
id are hits like others, but it is no item that has an id to list; items
without a word are left out; repeated items count as one id; texts of any
length are streamed whole; equal rows give equal rows; an empty benchmark hits
nothing; columns of the caller pass through unread.
"""

from __future__ import annotations

import hashlib
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import free_name, written
from roundlearn.session import ship_package

WINDOW = 13                # words; fixed value
MIN_SHARE = 20             # contaminated: MIN_SHARE * n_hit >= n_words; fixed value
BLOCK_WORDS = 100_000      # expected words of benchmark items in one automaton

# A-Z become a-z; ASCII characters that are no letters or digits become spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton over the words of many items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts: dict[tuple, set[str]] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words(text))
            if ids:
                texts.setdefault(ids, set()).add(item)
        for ids in texts:
            state = 0
            for c in ids:
                state = self._extend(state, c)
        self._mark(texts)

    def _add(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the strings of q that p's longest string and c give."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:                 # another item has this string already
            return self._split(last, self.next[last][c], c)
        cur, p = self._add({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, self.next[p][c], c)
        return cur

    def _up(self, state: int, n: int) -> int:
        """The state of the last n words of the strings of ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, texts: dict[tuple, set[str]]) -> None:
        w = self.window
        windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, frozenset]]] = {}
        for ids, items in texts.items():
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= w:
                    windows.setdefault(self._up(state, w), set()).update(items)
            if len(ids) < w:
                self.short.setdefault(self._up(state, len(ids)), []).append((len(ids), frozenset(items)))
        self.at_window = {}                      # state of a longer match -> items of its last window
        for s in range(1, len(self.next)):
            if self.length[s] >= w:
                self.at_window[s] = frozenset(windows.get(self._up(s, w), ()))
        self.has_short = set()                   # states with a short item among their suffixes
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if s in self.short or self.link[s] in self.has_short:
                self.has_short.add(s)
        self.least = min([w, *(n for x in self.short.values() for n, _ in x)])

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, hit word ranges merged, items) of one text."""
        ws = words(text)
        get = self.vocab.get
        ids = [get(x, -1) for x in ws]
        spans: list[list[int]] = []
        items: set[str] = set()
        start, n = 0, len(ids)
        least = self.least
        while start < n:
            # the next run of known words
            while start < n and ids[start] < 0:
                start += 1
            end = start
            while end < n and ids[end] >= 0:
                end += 1
            if end - start >= least:
                self._run(ids, start, end, spans, items)
            start = end
        return n, [(a, b) for a, b in spans], items - {None}

    def _run(self, ids: list[int], start: int, end: int, spans: list, items: set) -> None:
        nxt, link, length, w = self.next, self.link, self.length, self.window
        state = run = 0
        for j in range(start, end):
            c = ids[j]
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                run += 1
            if run >= w:
                items |= self.at_window[state]
                self._cover(spans, j + 1 - w, j + 1)
            if state in self.has_short:
                s = state
                while s > 0:
                    for k, found in self.short.get(s, ()):
                        if k <= run:
                            items |= found
                            self._cover(spans, j + 1 - k, j + 1)
                    s = link[s]

    @staticmethod
    def _cover(spans: list, a: int, b: int) -> None:
        while spans and spans[-1][1] >= a:       # a longer window may reach back over several
            a = min(a, spans.pop()[0])
        spans.append([a, b])


def blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> tuple[int, Iterator[list[tuple[str | None, str]]]]:
    """How many blocks the items make, and the blocks, each of about
    ``block_words`` words and read when it is asked for. A block is one hash
    class of the items."""
    src = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.where("text is not null").distinct()
    total = src.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    if n == 1:
        return n, iter([[tuple(r) for r in src.collect()]])
    src = written(src, "benchmark-items")
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return n, ([tuple(r) for r in src.where(part == i).collect()] for i in range(n))


#: A worker's automaton, by the broadcast of its block: it goes when the worker
#: takes a task that does not use the broadcast.
_built: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _automaton(block) -> Automaton:
    if block not in _built:
        _built[block] = Automaton(*block.value)
    return _built[block]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_HIT_KINDS = ["long", "array<struct<a:int,b:int>>", "array<string>"]


def _hit_columns(found: list[tuple]) -> list[pa.Array]:
    return [pa.array([n for n, _, _ in found], pa.int64()),
            pa.array([[{"a": x, "b": y} for x, y in spans] for _, spans, _ in found], _SPANS),
            pa.array([sorted(ids) for _, _, ids in found], pa.list_(pa.string()))]


def _text_key(text: str | None) -> bytes | None:
    return hashlib.md5(text.encode()).digest() if text else None


def match(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
          prefix: str = "", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """The rows of ``df`` with n_words, hit_spans (word ranges) and hit_items
    (ids as text), named with ``prefix`` and kept apart from its columns.
    ``then`` changes rows of these columns in the same Python worker: a
    second step of its own would need another one a task."""
    then = then or (lambda b: b)
    spark = df.sparkSession
    ship_package(spark)
    names = [free_name(df.columns, prefix + x) for x in ("n_words", "hit_spans", "hit_items")]
    at = df.columns.index(text_col)
    n, each = blocks(items, item_id, item_text, block_words)
    if n == 1:
        shared = spark.sparkContext.broadcast((next(each), window))

        def run(batches):
            for b in batches:
                auto = _automaton(shared)
                found = [auto.hits(t) for t in b.column(at).to_pylist()]
                yield then(pa.RecordBatch.from_arrays([*b.columns, *_hit_columns(found)], names=[*b.schema.names, *names]))
        out = df
        for k, c in zip(_HIT_KINDS, names, strict=True):
            out = out.withColumn(c, F.lit(None).cast(k))
        return df.mapInArrow(run, out.schema)
    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = [_block_hits(texts, block, window) for block in each]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    # one row a block and text: a key has at most as many as there are blocks
    merged = hits.groupBy("key").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    key, n_words, spans, found = (free_name([*df.columns, *names], x) for x in ("text_key", "words", "spans", "items"))
    merged = merged.toDF(f"{key}_2", spans, found)

    def keyed(batches):
        for b in batches:
            ts = b.column(at).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_text_key(t) for t in ts], pa.binary()),
                                              pa.array([len(words(t)) for t in ts], pa.int64())], names=[*b.schema.names, key, n_words])

    def joined(batches):
        for b in batches:
            ss, ids = ([x or [] for x in b.column(c).to_pylist()] for c in (spans, found))
            rows = []
            for s in ss:
                whole: list[dict] = []
                for x in s:
                    whole = merge(whole, x)
                rows.append(whole)
            cols = [b.column(c) for c in b.schema.names if c not in (spans, found)]
            yield then(pa.RecordBatch.from_arrays([*cols, pa.array(rows, _SPANS),
                                                   pa.array([sorted({y for z in x for y in z}) for x in ids], pa.list_(pa.string()))],
                                                  names=[*b.schema.names[:-2], *names[1:]]))
    out = df.mapInArrow(keyed, df.select("*", F.lit(None).cast("binary").alias(key), F.lit(None).cast("long").alias(n_words)).schema)
    out = out.join(merged, F.col(key) == F.col(f"{key}_2"), "left").drop(key, f"{key}_2").withColumnRenamed(n_words, names[0])
    schema = out.drop(spans, found)
    for k, c in zip(_HIT_KINDS[1:], names[1:], strict=True):
        schema = schema.withColumn(c, F.lit(None).cast(k))
    return out.mapInArrow(joined, schema.schema)


def _block_hits(texts: DataFrame, block: list, window: int) -> DataFrame:
    """(key, spans, items) of the distinct texts that one block hits,
    written; the block is let go after that."""
    shared = texts.sparkSession.sparkContext.broadcast((block, window))

    def run(batches):
        for b in batches:
            auto, rows = _automaton(shared), {}
            for t in b.column(0).to_pylist():
                if t and (key := _text_key(t)) not in rows and (found := auto.hits(t))[1]:
                    rows[key] = found
            if rows:
                _, spans, items = _hit_columns(list(rows.values()))
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), spans, items], names=["key", "spans", "items"])
    hits = texts.mapInArrow(run, f"key binary, spans {_HIT_KINDS[1]}, items {_HIT_KINDS[2]}")
    out = written(hits.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "block-hits")
    shared.unpersist()
    return out


def merge(old: list[dict], new: list[dict]) -> list[dict]:
    """Union of two sorted lists of ranges."""
    if not old or not new:
        return old or new
    out: list[dict] = []
    for x in sorted([*old, *new], key=lambda r: (r["a"], r["b"])):
        if out and x["a"] <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], x["b"])
        else:
            out.append(dict(x))
    return out


def digest(matched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, item digest and verdict of ``match``'s rows."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return (matched.select(F.col(id_col).alias("doc_id"), "n_words", n_hit.alias("n_hit"), "hit_items", "hit_spans")
            .select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
                    "hit_spans", "hit_items"))


def keep_clean(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
               min_share: int = MIN_SHARE, max_run: int | None = None, length_col: str | None = None) -> DataFrame:
    """The rows of ``df`` that are not contaminated. With ``max_run`` their
    hit runs of so many words or more are taken out of the text, and
    ``length_col`` is set anew where a text changed."""
    words_at = len(df.columns)                           # match's columns come last
    cut = _cutter(df.columns, text_col, max_run, None, length_col) if max_run else None

    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        n_hits = [sum(s["b"] - s["a"] for s in spans) for spans in b.column(words_at + 1).to_pylist()]
        b = b.filter(pa.array([not (n > 0 and min_share * n >= w)
                               for n, w in zip(n_hits, b.column(words_at).to_pylist(), strict=True)], pa.bool_()))
        return cut(b) if cut else b
    return match(df, items, text_col, item_id, item_text, then=clean).select(*[F.col(f"`{c}`") for c in df.columns])


def _cut(text: str | None, spans: list[dict], max_run: int, min_share: int | None) -> str | None:
    """The text without its hit ranges of ``max_run`` words or more, or
    without all of them if together they reach the share."""
    if not text or not spans:
        return text
    data = text.encode()
    flat = data.translate(_TABLE)
    bounds, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    over = min_share is not None and min_share * sum(s["b"] - s["a"] for s in spans) >= len(bounds)
    out, last = [], 0
    for s in spans:
        if over or s["b"] - s["a"] >= max_run:
            out.append(data[last:bounds[s["a"]][0]])
            last = bounds[s["b"] - 1][1]
    return b"".join([*out, data[last:]]).decode()


def remove_spans(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", max_run: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """All rows, with the hit spans over the length or coverage limit taken
    out of the text."""
    cut = _cutter(df.columns, text_col, max_run, min_share, None)
    return match(df, items, text_col, item_id, item_text, then=cut).select(*[F.col(f"`{c}`") for c in df.columns])


def _cutter(columns: list[str], text_col: str, max_run: int, min_share: int | None,
            length_col: str | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Takes hit runs out of the texts of ``match``'s rows of a table with these columns."""
    at, spans_at = columns.index(text_col), len(columns) + 1
    len_at = columns.index(length_col) if length_col in columns else None

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(b.columns)
        old = cols[at].to_pylist()
        new = [_cut(t, s, max_run, min_share) for t, s in zip(old, cols[spans_at].to_pylist(), strict=True)]
        cols[at] = pa.array(new, b.schema.field(at).type)
        if len_at is not None:
            lengths = [n if x == y else len(y) for n, x, y in zip(cols[len_at].to_pylist(), old, new, strict=True)]
            cols[len_at] = pa.array(lengths, b.schema.field(len_at).type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return cut
