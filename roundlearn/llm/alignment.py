"""Alignment of two tokenizers' tokens at the byte offsets where both end.

A: a byte-level BPE vocabulary (``tokenizers`` file); B: a SentencePiece model.
Neither has a token over a blank that follows a character that is no white
space (checked for the vocabularies when they are loaded), so texts are encoded
by the chunks between such blanks, and the ids of chunks are remembered.
Both cut the same bytes, a space and the text. Their common ends are found by
divide and conquer: of an interval of A's tokens the ends are looked up among
B's by bisection, the middle one first, then further and further from it; at
the nearest common end the interval falls into two, with nothing of what was
tested between them. An interval without a common end is one leaf group. The
intervals of all documents of a part of a batch are worked on together, as
arrays. Tokens between two neighbouring cuts form a group, and every token of A
in it is linked with every one of B.

How many documents link an id pair is counted by Spark over the distinct pairs
of each document (written once, with their numbers of occurrences), summed map
side first. A document's links then need the counts of its pairs: the pairs
with the largest counts, at most ``HOT_PAIRS`` of them, go to all tasks as two
sorted arrays; links with rarer pairs are joined by a shuffle, and as a rare
pair is in few documents no key of that join is hot. Nothing is left out.

Cases: a null or empty text, and one whose tokens' bytes are not those of the
space and the text (a literal piece mark, say), has no tokens: all counts are
0 and the digest is ''; texts of any length are aligned whole; special tokens'
strings in a text are text; equal rows get equal results; each repeated row
counts as a document; a null id stays; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import by_batch, parts, written
from roundlearn.session import ship_package

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
SHIFT = 20                 # a pair's key: A's id << SHIFT | B's id
HOT_PAIRS = 500_000        # pairs whose counts are sent to the tasks: 12 bytes each
PART_BYTES = 2 << 20       # texts of a batch that are aligned together
LINKS = 1 << 22            # links that are expanded at a time
CACHED = 200_000           # chunks after which a worker forgets those not met lately
LONG = 100                 # characters of a chunk that is not remembered
CHUNK = re.compile(r"(?<=\S)(?= )")
_WHITE = np.array([i < 128 and chr(i).isspace() for i in range(256)])
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]


# ---- the tokenizers

def _byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for:
    printable ones for themselves, the others, in order, from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


def chunks(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of all texts, each with a blank before it, end to end, and
    how many each text has: ``CHUNK``'s cuts, found in the bytes."""
    raw = [(" " + t).encode() if t else b"" for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    raw = b"".join(raw)
    at = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(sizes)
    begin = np.zeros(len(at), bool)
    begin[(ends - sizes)[sizes > 0]] = True
    to = np.flatnonzero((at == 32) & ~begin)
    last = at[to - 1]
    white = _WHITE[last]
    odd = np.flatnonzero(last >= 0x80)        # of a longer character the bytes before count too
    if len(odd):
        for space in _WIDE:
            same = np.ones(len(odd), bool)
            for k, byte in enumerate(reversed(space)):
                same &= at[to[odd] - 1 - k] == byte
            white[odd[same]] = True
    begin[to[~white]] = True
    starts = np.flatnonzero(begin)
    cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw))
    return cut.dictionary_encode(), np.diff(np.searchsorted(starts, ends), prepend=0)


class Encoder:
    """Both tokenizers, by chunks."""

    def __init__(self, vocabulary: str, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(vocabulary)
        self.a.encode_special_tokens = True   # their strings in a text are plain text
        alphabet = _byte_alphabet()
        if self.a.normalizer is not None or not alphabet.keys() <= self.a.get_vocab().keys():
            raise ValueError("the byte-level vocabulary does not know every byte, or changes texts")
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(self.b.get_piece_size())
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in ids]
        special = {i for i in ids if self.b.is_control(i) or self.b.is_unknown(i)}
        texts = [x.decode("utf-8", "replace") for x in (*self.a_bytes, *(x for i, x in enumerate(self.b_bytes) if i not in special))]
        if any(CHUNK.search(x) for x in texts):
            raise ValueError("a token holds a blank after another character: texts cannot be encoded by chunks")
        self.blank = self.b.piece_to_id("▁")
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _encode(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and of B, as 32-bit numbers, of chunks, each of which
        begins with a blank; None where B's bytes are not the chunk's."""
        out: list = []
        if not chunks:
            return out
        a = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)          # the model adds the first blank
        piece = self.b_bytes.__getitem__
        for c, x, y in zip(chunks, a, b):
            y = [self.blank] if c == " " else y
            out.append((array("i", x.ids).tobytes(), array("i", y).tobytes()) if b"".join(map(piece, y)) == c.encode() else None)
        return out

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, end to end, and how many each text has; the same for B.
        A text has none where B's bytes are not those of a blank and the
        text (A's always are: it knows every byte and changes none)."""
        cut, sizes = chunks(texts)
        word, words = cut.indices.to_numpy(), cut.dictionary.to_pylist()
        if len(self.young) > CACHED:          # what was not met since the last time is forgotten
            self.young, self.old = {}, self.young
        known, old, new = self.young, self.old, []
        for c in words:
            if c not in known:
                if c in old:
                    known[c] = old[c]
                else:
                    new.append(c)
        known.update(zip(new, self._encode(new)))
        got = [known[c] for c in words]
        if None in got:
            bad = np.fromiter((x is None for x in got), bool, len(got))[word]
            text = np.repeat(np.arange(len(sizes)), sizes)
            sizes[np.unique(text[bad])] = 0
            word = word[sizes[text] > 0]
            got = [x or (b"", b"") for x in got]
        ends, at = np.cumsum(sizes), word.tolist()
        out = []
        for side in (0, 1):
            ids = [x[side] for x in got]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            upto = np.concatenate([[0], np.cumsum(n[word])])[ends]
            out += [np.frombuffer(b"".join(map(ids.__getitem__, at)), np.int32).astype(np.int64), np.diff(upto, prepend=0)]
        for c in new:
            if len(c) > LONG:
                del known[c]
        return tuple(out)


# ---- shared cuts

def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each of ``a_ends`` is in ``b_ends`` (both strictly
    increasing), by divide and conquer in the intervals ``starts`` cut of A's
    tokens. An interval is cut at the common end nearest to its middle."""
    cut = np.zeros(len(a_ends), bool)
    lo, hi = starts[:-1].copy(), starts[1:].copy()

    def common(at: np.ndarray) -> np.ndarray:
        found = np.searchsorted(b_ends, a_ends[at])
        return (found < len(b_ends)) & (b_ends[np.minimum(found, len(b_ends) - 1)] == a_ends[at])

    while len(lo := lo[(live := lo < hi)]):
        hi = hi[live]
        mid = (lo + hi) >> 1
        far = np.zeros(len(lo), np.int64)     # distance of the nearest common end, once it is found
        open_, near, width = np.arange(len(lo)), 0, 1
        while len(open_):
            # both sides of the middle at the distances near .. near + width - 1
            d = np.arange(near, near + width)
            at = np.concatenate([mid[open_, None] - d, mid[open_, None] + d], 1)
            inside = (at >= lo[open_, None]) & (at < hi[open_, None])
            hit = np.zeros(at.shape, bool)
            hit[inside] = common(at[inside])
            any_at = hit[:, :width] | hit[:, width:]
            first = any_at.argmax(1)
            has = any_at[np.arange(len(open_)), first]
            ended = ~inside[:, [width - 1, 2 * width - 1]].any(1) & ~has
            far[open_[has]] = near + first[has]
            for side in (first, first + width):
                both = has & hit[np.arange(len(open_)), side]
                cut[at[np.arange(len(open_)), side][both]] = True
            far[open_[ended]] = -1            # a leaf
            open_ = open_[~has & ~ended]
            near, width = near + width, min(2 * width, max(1, LINKS // max(1, 2 * len(open_))))
        go = far >= 0
        lo, hi, mid, far = lo[go], hi[go], mid[go], far[go]
        lo, hi = np.concatenate([lo, mid + far + 1]), np.concatenate([mid - far, hi])
    return cut


def align_tokens(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray,
                 starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B; ends are byte offsets in the
    joined documents, each of which both tokenizers end with a cut."""
    cut = shared_cuts(a_ends, b_ends, starts)
    a_group = np.concatenate([[0], np.cumsum(cut)[:-1]]) if len(cut) else np.zeros(0, np.int64)
    return a_group, np.searchsorted(a_ends[cut], b_ends)


def _runs(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def link_pairs(a_ids, a_group, b_ids, b_group, doc_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair key, links) of the distinct pairs of each document.
    Links are expanded for a bounded number of A's tokens at a time."""
    n_b = np.bincount(b_group, minlength=len(doc_of_group))
    b_first = np.cumsum(n_b) - n_b
    links = n_b[a_group]
    parts, a, total = [], 0, np.cumsum(links)
    while a < len(a_ids):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LINKS, "right")))
        n = links[a:z]
        # the tokens of B in the group of each token of A
        b_at = np.repeat(b_first[a_group[a:z]], n) + _runs(n)
        key = (np.repeat(a_ids[a:z], n).astype(np.int64) << SHIFT) | b_ids[b_at]
        doc = np.repeat(doc_of_group[a_group[a:z]], n).astype(np.int64)
        parts.append(_summed(doc, key, np.ones(len(key), np.int64)))
        a = z
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return parts[0] if len(parts) == 1 else _summed(*map(np.concatenate, zip(*parts)))


def _summed(doc: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((key, doc))
    doc, key, n = doc[order], key[order], n[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    return doc[first], key[first], np.add.reduceat(n, first) if len(first) else n


class Aligner:
    """Groups, links and pairs of the documents of a part of a batch."""

    def __init__(self, vocabulary: str, model: str):
        self.encoder = Encoder(vocabulary, model)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64)
                                    for side in (self.encoder.a_bytes, self.encoder.b_bytes))
        na, nb = len(self.a_size), len(self.b_size)
        # an id with what follows it: "," in a side, "|" after A's last, ";" after B's last
        self.words = np.array([f"{i}{c}" for n, cs in ((na, ",|"), (nb, ",;")) for c in cs for i in range(n)], object)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups text, pair keys, links of
        each) of each text."""
        a_ids, n_a, b_ids, n_b = self.encoder.tokens(texts)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        starts = np.concatenate([[0], np.cumsum(n_a)])
        a_group, b_group = align_tokens(a_ids, a_end, b_ids, b_end, starts)
        n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
        a_in, b_in = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        doc_of_group = np.zeros(n_groups, np.int64)
        doc_of_group[a_group] = np.repeat(np.arange(len(texts)), n_a)
        groups = np.bincount(doc_of_group, minlength=len(texts))
        links = np.zeros(len(texts), np.int64)
        np.add.at(links, doc_of_group, a_in * b_in)
        listed = self._listed(a_ids, a_group, a_in, b_ids, b_group, b_in)
        doc, key, n = link_pairs(a_ids, a_group, b_ids, b_group, doc_of_group)
        t_cut = np.concatenate([[0], np.cumsum(n_a + n_b)])
        p_cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [(int(n_a[d]), int(n_b[d]), int(groups[d]), int(links[d]), "".join(listed[t_cut[d]:t_cut[d + 1]])[:-1],
                 key[p_cut[d]:p_cut[d + 1]], n[p_cut[d]:p_cut[d + 1]]) for d in range(len(texts))]

    def _listed(self, a_ids, a_group, a_in, b_ids, b_group, b_in) -> list[str]:
        """The parts of the groups' text, in order."""
        na, nb = len(self.a_size), len(self.b_size)
        out = np.zeros(len(a_ids) + len(b_ids), np.int64)
        a_upto, b_upto = np.cumsum(a_in), np.cumsum(b_in)
        i, j = np.arange(len(a_ids)), np.arange(len(b_ids))
        out[i + (b_upto - b_in)[a_group]] = a_ids + na * (i + 1 == a_upto[a_group])
        out[j + a_upto[b_group]] = 2 * na + b_ids + nb * (j + 1 == b_upto[b_group])
        return self.words[out].tolist()


# ---- Spark

def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY_A,
            model: str = MODEL_B, with_groups: bool = True) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, links)
    of each document; ``pairs`` are its distinct pair keys, ``links`` how
    often each is linked, ``groups`` the text (null unless asked for)."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def rows_of(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        n_a, n_b, groups, links, listed, keys, ns = zip(*found)
        cuts = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)),
             pa.array(listed if with_groups else [None] * len(listed), pa.string()),
             pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in listed], pa.string()),
             pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(keys), pa.int64())),
             pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(ns), pa.int64()))],
            ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary, model)
        for b in batches:
            for p in parts(b.column("text"), PART_BYTES):
                yield rows_of(b.column("id")[p], aligner.align(b.column("text")[p].to_pylist()))
    ship_package(docs.sparkSession)
    id_type = src.schema["id"].dataType.simpleString()
    found = src.mapInArrow(run, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups string, "
                               "groups_sha256 string, pairs array<bigint>, links array<bigint>")
    return found.withColumnRenamed("id", id_col)


@functools.cache
def _aligner(vocabulary: str, model: str) -> Aligner:
    return Aligner(vocabulary, model)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n_docs, best) over the distinct pairs of all documents; best:
    no pair of its A id is in more documents."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = written(counts.withColumn("a", F.shiftright("pair", SHIFT)), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(top, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def hot_bound(counts: DataFrame, hot_pairs: int) -> int:
    """The least power of two such that at most ``hot_pairs`` pairs are in
    so many documents (by a table of at most 64 rows)."""
    sizes = {r.k: r.n for r in counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    k, room = max(sizes, default=-1) + 1, hot_pairs
    while k > 0 and sizes.get(k - 1, 0) <= room:
        k -= 1
        room -= sizes.get(k, 0)
    return 1 << k


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY_A,
          model: str = MODEL_B, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Counts and digest of each document's groups, its links whose pair is
    best for its A id (``n_best``), and the counts of its links' pairs summed
    (``count_sum``)."""
    spark = docs.sparkSession
    rows = aligned(docs, id_col, text_col, vocabulary, model, with_groups=False).drop("groups")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pairs")
    bound = hot_bound(counts, hot_pairs)
    hot = counts.where(F.col("n_docs") >= bound).toArrow()       # at most hot_pairs rows
    keys, n_docs = (hot[c].to_numpy() for c in ("pair", "n_docs"))
    order = np.argsort(keys)
    signed = n_docs[order] * np.where(hot["best"].to_numpy()[order], 1, -1)      # best ones are positive
    shared = spark.sparkContext.broadcast((keys[order], signed))

    def look(b: pa.RecordBatch) -> pa.RecordBatch:
        """Sums over the hot pairs, and the other pairs."""
        keys, signed = shared.value
        pairs, links = b.column("pairs"), b.column("links").flatten().to_numpy()
        flat, sizes = pairs.flatten().to_numpy(), pairs.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(b)), sizes)
        at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
        found = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
        value = np.where(found, signed[at] if len(keys) else 0, 0)
        best, total = (np.zeros(len(b), np.int64) for _ in range(2))
        np.add.at(best, row, links * (value > 0))
        np.add.at(total, row, links * np.abs(value))
        cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=len(b)))]), pa.int32())
        cold = [pa.ListArray.from_arrays(cuts, pa.array(x[~found], pa.int64())) for x in (flat, links)]
        names = [c for c in b.schema.names if c not in ("pairs", "links")]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(best), pa.array(total), *cold],
                                          [*names, "n_best", "count_sum", "pairs", "links"])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("pairs", "links")]
    found = by_batch(rows, look, ", ".join([*kept, "n_best long, count_sum long, pairs array<bigint>, links array<bigint>"]))
    out = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if bound == 1:                            # no pair is left over
        return found.select(*out)
    cold = (found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x"))
            .select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
            .join(counts.where(F.col("n_docs") < bound), "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("cold_best"),
                                F.sum(F.col("links") * F.col("n_docs")).alias("cold_sum")))
    return found.join(cold, "row", "left").select(
        *out[:5], (F.col("n_best") + F.coalesce("cold_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("cold_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
