"""Subword encoding by ranked merges with seeded merge dropout, and decoding.

The vocabulary is that of a SentencePiece BPE model file. A text is cut into
pretokens (spaces with the word that follows them, lines apart); in each, the
agenda of adjacent pairs is processed best rank first, leftmost on ties. Every
candidate merge is skipped if a keyed hash of its place falls under the dropout
rate: of the seed, the document's id, the number of the pretoken in the
document and the place in the pretoken. So a seed (an epoch, say) fixes one
segmentation of a document and another seed gives another, and each occurrence
of a word is drawn by itself (``variants`` limits the documents' streams to so
many, if given). Only what no draw touches is remembered between occurrences:
the merges of a pretoken without dropout and the candidates they meet, none of
which may be skipped. With no dropout the ids are those of the model itself. Characters
without a piece become byte pieces, and a literal piece mark in the text does
too, so that decoding gives back every text exactly.

Short pretokens of a batch are merged together, those of like length as the
columns of one matrix, one merge of each a step; long ones by an agenda on a
heap. Both process the same candidates in the same order and give the same ids.

Cases: a null text has null ids and counts 0; an empty text has no ids; texts
and words of any length are encoded whole; a null id draws its stream as the
text "null"; equal rows get equal ids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import weakref
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import IntMap
from roundlearn.session import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
MARK = "▁"
CACHED = 50_000            # pretokens, with their candidates, after which a worker forgets those not met lately
SHORT = 32                 # characters; longer pretokens go by the heap
AT_ONCE = 1_000_000        # bytes of text that a worker encodes together
COLUMNS = 8_192            # pretokens in a matrix
_SHIFT = 6                 # bits of a place in a short pretoken
_PAD = -0x200000           # what follows the last symbol of a pretoken
_M = (1 << 64) - 1


def load_pieces(model: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 0: piece, 1: byte, 2: other."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(sp.id_to_piece(i), sp.get_score(i), 1 if sp.is_byte(i) else
             2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0) for i in range(sp.get_piece_size())]


def _scramble(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def _scrambled(x: np.ndarray) -> np.ndarray:
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all spans that start at ``first``, end to end."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


class Merger:
    """Merge tables of a vocabulary, and the merges of pretokens."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 0}
        self.byte = {}
        self.bytes_of = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 1:
                self.byte[int(p[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(p[1:-1], 16)])
            elif kind == 0:
                self.bytes_of[i] = p.replace(MARK, " ").encode()
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any("\n" in p or MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("the vocabulary has pieces that cross words or lines")
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        self.char[" "] = self.char.pop(MARK, -1)
        self.by_code = -1 - np.arange(0x110000, dtype=np.int32)     # a character without a piece: below 0
        for c, i in self.char.items():
            self.by_code[ord(c)] = i
        order = sorted(ids.values(), key=lambda i: (-pieces[i][1], i))
        rank = {i: r for r, i in enumerate(order)}
        self.width = len(pieces)
        self.merge: dict[int, tuple[int, int]] = {}          # pair -> (rank, id)
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    self.merge[a * self.width + b] = (rank[i], i)
        self.none = len(pieces)                              # past every rank
        keys = np.array(list(self.merge), np.int64)
        self.table = IntMap(keys, np.array([r for r, _ in self.merge.values()], np.int64))
        self.by_rank = np.array(order, np.int32)             # the id of each rank
        self.of_byte = np.array([self.byte[b] for b in range(256)], np.int32)
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n_raw = np.fromiter(map(len, self.bytes_of), np.int64, len(pieces))

    def symbols(self, word: str) -> list[int]:
        get = self.char.get
        return [get(c, -1) for c in word]

    def _out(self, word: str, ids: list[int], starts: list[int]) -> bytes:
        if -1 in ids:
            full: list[int] = []
            for i, s in zip(ids, starts, strict=True):
                full += [i] if i >= 0 else [self.byte[b] for b in word[s].encode()]
            ids = full
        return np.array(ids, np.int32).tobytes()

    # ---- one long pretoken: an agenda on a heap

    def by_agenda(self, word: str, key: int, limit: int) -> bytes:
        sym = self.symbols(word)
        n = len(sym)
        end = list(range(1, n + 1))                          # by start: where the symbol ends
        before = list(range(-1, n - 1))                      # by start: start of the symbol before
        heap: list[tuple[int, int, int, int, int]] = []
        merge, width = self.merge, self.width

        def offer(a: int) -> None:
            b = end[a]
            if b < n and sym[a] >= 0 and sym[b] >= 0:
                found = merge.get(sym[a] * width + sym[b])
                if found and (not limit or _scramble(key ^ _scramble(a << 42 | b << 21 | end[b])) >= limit):
                    heapq.heappush(heap, (found[0], a, b, end[b], found[1]))

        for a in range(n):
            offer(a)
        alive = [True] * n
        while heap:
            _, a, b, e, i = heapq.heappop(heap)
            if not alive[a] or end[a] != b or not alive[b] or end[b] != e:
                continue                                     # one of the two has been merged meanwhile
            sym[a], end[a], alive[b] = i, e, False
            if e < n:
                before[e] = a
                offer(a)
            if before[a] >= 0:
                offer(before[a])
        starts = [a for a in range(n) if alive[a]]
        return self._out(word, [sym[a] for a in starts], starts)

    # ---- many short pretokens: one merge of each a step

    def coded(self, text: str) -> np.ndarray:
        """The symbols of the characters; -1 - code of those without a piece."""
        return self.by_code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the merges of symbols; no merge: past all others."""
        out = np.full(len(left), self.none, np.int32)
        ok = np.flatnonzero((left >= 0) & (right >= 0))
        found, rank = self.table.get(left[ok].astype(np.int64) * self.width + right[ok])
        out[ok[found]] = rank[found]
        return out

    def pairs(self, sym: np.ndarray) -> np.ndarray:
        """The rank of each symbol's merge with the next."""
        return self.ranks(sym, np.append(sym[1:], np.int32(_PAD))[:len(sym)])

    def _drawn(self, rank, a, b, end, own, keys, limit, met):
        """Rank and place (a) of the merges of neighbours that start at a and b
        and stop before ``end``; no merge, or a skipped one: past all others."""
        out = np.full(len(rank), self.none << _SHIFT, np.int32)
        ok = np.flatnonzero(rank < self.none)
        if limit or met is not None:
            u, of = np.uint64, own[ok]
            place = _scrambled((a[ok].astype(u) << u(42)) | (b[ok].astype(u) << u(21)) | end[ok].astype(u))
            if met is not None:
                met.append((of, place))
            if limit:
                ok = ok[_scrambled(keys[of] ^ place) >= u(limit)]
        out[ok] = rank[ok] << _SHIFT | a[ok]
        return out

    def _columns(self, sym, rank, size, own, keys, limit, met):
        """Merges the pretokens in the columns of ``sym``, each with at least
        one pad below; ``rank`` has the ranks of the pairs of its rows. Gives
        (own, counts, ids end to end) as they get done."""
        rows, m = sym.shape
        start = np.repeat(np.arange(rows, dtype=np.uint8), m).reshape(rows, m)
        at = start[:-1].ravel()
        rank = self._drawn(rank.ravel(), at, at + 1, at + 2, np.tile(own, rows - 1), keys, limit, met).reshape(rows - 1, m)
        while True:
            best = rank.min(axis=0)
            done = best >= self.none << _SHIFT
            if done.any():
                ids = sym[:, done].T
                there = (start[:, done] < size[done]).T
                yield own[done], there.sum(axis=1), ids[there]
                live = np.flatnonzero(~done)
                if not len(live):
                    return
                sym, start, rank = (x.take(live, axis=1) for x in (sym, start, rank))
                size, own, best = size[live], own[live], best[live]
            m = len(own)
            a = (best & ((1 << _SHIFT) - 1)).astype(np.uint8)
            after = start > a                                # the first of them is merged into the one before
            row = len(sym) - 1 - np.add.reduce(after.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
            sym, start = (np.where(after[:-1], x[1:], x[:-1]) for x in (sym, start))
            rank = np.where(after[:-2], rank[1:], rank[:-1])
            at = row * m + np.arange(m)
            flat, begin, new = sym.reshape(-1), start.reshape(-1), self.by_rank[best >> _SHIFT]
            flat[at] = new
            end = begin[at + m]
            more = np.flatnonzero(row)                       # those with a symbol before
            before = at[more] - m
            rank.reshape(-1)[np.concatenate([at, before])] = self._drawn(
                self.ranks(np.concatenate([new, flat[before]]), np.concatenate([flat[at + m], new[more]])),
                np.concatenate([a, begin[before]]), np.concatenate([end, a[more]]),
                np.concatenate([begin.take(at + 2 * m, mode="clip"), end[more]]), np.concatenate([own, own[more]]),
                keys, limit, met)

    def merged(self, sym: np.ndarray, pairs: np.ndarray, first: np.ndarray, lens: np.ndarray, keys: np.ndarray, limit: int,
               met: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the short pretokens that stand in ``sym`` at ``first``, as
        (ids, where each one's start, how many it has). ``pairs`` has the rank
        of each symbol with the next; ``met`` gets the candidates, as
        (pretokens, scrambled places)."""
        if len(lens) and lens.max() > SHORT:
            raise ValueError("a pretoken is too long")
        order = np.argsort(lens.astype(np.uint8), kind="stable")
        tall = np.array([*range(13), *(-(-n // 4) * 4 for n in range(13, SHORT + 1))])      # rows by length
        got = []
        bounds = np.searchsorted(tall[lens[order]], np.unique([*tall, tall[-1] + 1]))
        for lo, hi in zip(bounds[1:-1].tolist(), bounds[2:].tolist(), strict=True):
            for i in range(lo, hi, COLUMNS):
                own = order[i:min(i + COLUMNS, hi)]
                size = lens[own]
                col = np.arange(tall[size[0]] + 1)[:, None]
                at = first[own] + col
                part = np.where(col < size, sym.take(at, mode="clip"), np.int32(_PAD))
                rank = np.where(col[1:] < size, pairs.take(at[:-1], mode="clip"), np.int32(self.none))
                got += self._columns(part, rank, size, own, keys, limit, met)
        at, count = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        if not got:
            return np.zeros(0, np.int32), at, count
        own, n = (np.concatenate([x[k] for x in got]) for k in (0, 1))
        at[own], count[own] = np.cumsum(n) - n, n
        return np.concatenate([x[2] for x in got]), at, count

    def spelled(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with byte pieces for characters without a piece, and the ends moved so."""
        odd = ids < 0
        if not odd.any():
            return ids, ends
        codes = -1 - ids[odd]
        raw = np.frombuffer(codes.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
        n = np.ones(len(ids), np.int64)
        n[odd] += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        out = np.repeat(ids, n)
        out[np.repeat(odd, n)] = self.of_byte[raw]
        return out, np.append(0, np.cumsum(n))[ends]

    def together(self, words: list[str], keys: np.ndarray, limit: int) -> list[bytes]:
        """The ids of each short word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.coded("".join(words))
        ids, at, count = self.merged(sym, self.pairs(sym), np.cumsum(lens) - lens, lens, keys, limit)
        ids, ends = self.spelled(ids[_spans(at, count)], np.cumsum(count))
        ends = ends.tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids end to end, and where those of the sequences end."""
        n = self.n_raw[ids]
        raw = self.raw[_spans((np.cumsum(self.n_raw) - self.n_raw)[ids], n)]
        return raw.tobytes(), np.append(0, np.cumsum(n))[ends]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode() if raw else ""


def pretokens(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pretokens of all texts, each with a space before it, end to end,
    and how many each text has. A pretoken begins at a line feed, after one
    and where spaces begin."""
    texts = [(" " + t).encode() if t else b"" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = b"".join(texts)
    at = np.frombuffer(raw, np.uint8)
    line, space = at == 10, at == 32
    begin = line | space
    begin[1:] &= ~(space[1:] & space[:-1])
    begin[1:] |= line[:-1]
    ends = np.cumsum(sizes)
    begin[(ends - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(begin)
    offsets = pa.py_buffer(np.append(starts, len(raw)))
    cut = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(raw))
    return cut.dictionary_encode(), np.diff(np.searchsorted(starts, ends), prepend=0)


class Encoder:
    """Encodes texts with one seed; remembers frequent pretokens."""

    def __init__(self, merger: Merger, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = None):
        if not 0 <= dropout < 1 or (variants is not None and variants < 1):
            raise ValueError("dropout must be in [0, 1) and variants at least 1")
        self.merger, self.seed, self.variants = merger, seed, variants
        self.limit = int(dropout * 2.0**64)
        self.known: dict[str, int] = {}                      # numbers of pretokens in the arrays below
        self.old: dict[str, int] = {}                        # the same, not met lately
        # Of each number, ids without dropout and scrambled places of the candidates.
        self.ids, self.first_id, self.n_ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.places, self.first_place, self.n_places = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def stream(self, doc_id) -> int:
        """The 64-bit key of a document under the seed."""
        raw = hashlib.blake2b(str("null" if doc_id is None else doc_id).encode(), digest_size=8,
                              key=f"doc {self.seed}".encode()).digest()
        n = int.from_bytes(raw, "big")
        return n if self.variants is None else _scramble(n % self.variants ^ _scramble(self.seed & _M))

    def _forget(self) -> None:
        """Forgets what was not met since the last time."""
        kept = np.fromiter(self.known.values(), np.int64, len(self.known))
        self.known, self.old = {}, dict(zip(self.known, range(len(kept)), strict=True))
        n, m = self.n_ids[kept], self.n_places[kept]
        self.ids, self.places = self.ids[_spans(self.first_id[kept], n)], self.places[_spans(self.first_place[kept], m)]
        self.first_id, self.n_ids, self.first_place, self.n_places = np.cumsum(n) - n, n, np.cumsum(m) - m, m

    def _plain(self, words: list[str], uses: np.ndarray, sym: np.ndarray, pairs: np.ndarray, first: np.ndarray,
               lens: np.ndarray) -> np.ndarray:
        """Each word's number, if it is remembered: a short one with more than
        one use is from now on. Else -1."""
        if len(self.known) > CACHED:
            self._forget()
        known, old = self.known, self.old
        out = np.array(list(map(known.get, words, repeat(-1))), np.int64)
        for w in np.flatnonzero(out < 0).tolist() if old else []:
            got = old.get(words[w])
            if got is not None:
                out[w] = known[words[w]] = got
        new = np.flatnonzero((out < 0) & (uses > 1) & (lens <= SHORT))
        if len(new):
            got = []
            for i in range(0, len(new), 20_000):
                part = new[i:i + 20_000]
                met: list[tuple[np.ndarray, np.ndarray]] = []
                ids, at, count = self.merger.merged(sym, pairs, first[part], lens[part], np.zeros(len(part), np.uint64), 0, met)
                own, place = (np.concatenate([x[k] for x in met]) for k in (0, 1))
                got.append((ids[_spans(at, count)], count, place[np.argsort(own, kind="stable")],
                            np.bincount(own, minlength=len(part))))
            base, (ids, n_ids, places, n_places) = len(self.n_ids), (np.concatenate(x) for x in zip(*got, strict=True))
            self.first_id = np.append(self.first_id, len(self.ids) + np.cumsum(n_ids) - n_ids)
            self.first_place = np.append(self.first_place, len(self.places) + np.cumsum(n_places) - n_places)
            self.ids, self.n_ids = np.append(self.ids, ids), np.append(self.n_ids, n_ids)
            self.places, self.n_places = np.append(self.places, places), np.append(self.n_places, n_places)
            out[new] = range(base, base + len(new))
            known.update(zip([words[w] for w in new.tolist()], range(base, base + len(new)), strict=True))
        return out

    def _touched(self, number: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which occurrences skip a candidate that their word meets without dropout."""
        n = self.n_places[number]
        skipped = _scrambled(np.repeat(key, n) ^ self.places[_spans(self.first_place[number], n)]) < np.uint64(self.limit)
        out = np.zeros(len(number), bool)
        out[np.repeat(np.arange(len(number)), n)[skipped]] = True
        return out

    def encode_flat(self, texts: list[str | None], doc_ids: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where those of each text end."""
        cut, sizes = pretokens(texts)
        word, words = cut.indices.to_numpy().astype(np.int64), cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        lens = pc.utf8_length(cut.dictionary).to_numpy().astype(np.int64)
        del cut
        sym, begin = self.merger.coded("".join(words)), np.cumsum(lens) - lens
        pairs = self.merger.pairs(sym)
        number = self._plain(words, np.bincount(word, minlength=len(words)), sym, pairs, begin, lens)[word]
        long = lens[word] > SHORT                            # never remembered
        streams = np.array([self.stream(d) for d in doc_ids], np.uint64)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = _scrambled(np.repeat(_scrambled(streams), sizes) + nth.astype(np.uint64))
        again = (number < 0) & ~long                         # merged with its own draws
        same = np.flatnonzero(number >= 0)
        if self.limit:
            for i in range(0, len(same), 50_000):
                part = same[i:i + 50_000]
                again[part] = self._touched(number[part], key[part])
            same = same[~again[same]]
        first, count = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        first[same], count[same] = self.first_id[number[same]], self.n_ids[number[same]]
        todo = np.flatnonzero(again)
        ids, at, count[todo] = self.merger.merged(sym, pairs, begin[word[todo]], lens[word[todo]], key[todo], self.limit)
        first[todo] = at + len(self.ids)
        parts, total = [self.ids, ids], len(self.ids) + len(ids)
        plain: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(long).tolist():
            w = int(word[i])
            got = plain.get(w)
            if got is None:
                got = np.frombuffer(self.merger.by_agenda(words[w], int(key[i]) if self.limit else 0, self.limit), np.int32)
                if not self.limit:
                    plain[w] = got
            first[i], count[i] = total, len(got)
            parts.append(got)
            total += len(got)
        ids = np.concatenate(parts)[_spans(first, count)]
        return self.merger.spelled(ids, np.append(0, np.cumsum(count))[np.cumsum(sizes)])

    def encode(self, texts: list[str | None], doc_ids: list) -> list[bytes | None]:
        """The ids of each text as 32-bit numbers end to end."""
        ids, ends = self.encode_flat(texts, doc_ids)
        ends = ends.tolist()
        return [None if t is None else ids[a:b].tobytes() for t, a, b in zip(texts, [0, *ends], ends, strict=False)]


#: A worker's encoder, by the broadcast of its vocabulary: it goes when the
#: worker takes a task that does not use the broadcast, so it does not stay
#: beside the next stages.
_ready: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _encoder(pieces, *params) -> Encoder:
    key, enc = _ready.get(pieces, (None, None))
    if key != params:
        enc = Encoder(Merger(pieces.value), *params)
        _ready[pieces] = params, enc
    return enc


def portions(b: pa.RecordBatch, col: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text in column ``col``."""
    n = b.column(col).nbytes // max(size, 1) + 1
    step = max(1, -(-b.num_rows // n))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
           dropout: float = DROPOUT, seed: int = SEED, variants: int | None = None, model: str = MODEL,
           with_ids: bool = True) -> DataFrame:
    """doc_id, the columns of ``keep``, n_tokens, ids_sha256, lossless (the
    ids decode to the text) and, if asked for, the ids."""
    ship_package(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model))        # one vocabulary, under 1 MB
    keep = keep or []
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    *[F.col(f"`{c}`") for c in keep])
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text"]
    schema = ", ".join([*out, "n_tokens long", "ids_sha256 string", "lossless boolean", *["ids array<int>"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pool = _encoder(pieces, dropout, seed, variants), pa.default_memory_pool()
        pool.release_unused()                                # what an earlier step left in this worker
        for b in batches:
            for p in portions(b, 1, AT_ONCE):
                texts = p.column(1).to_pylist()
                ids, ends = enc.encode_flat(texts, p.column(0).to_pylist())
                raw, stops = enc.merger.decoded(ids, ends)
                ok = [t is None or raw[a + 1:b] == t.encode()
                      for t, a, b in zip(texts, [0, *stops.tolist()], stops.tolist(), strict=False)]
                none = np.array([t is None for t in texts], bool)
                digest = [None if t is None else hashlib.sha256(ids[a:b]).hexdigest()
                          for t, a, b in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False)]
                cols = [p.column(0), *[p.column(i + 2) for i in range(len(keep))],
                        pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(digest, pa.string()), pa.array(ok, pa.bool_())]
                if with_ids:
                    offsets = pa.array(np.append(0, ends).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(ids), mask=pa.array(none)))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *keep, "n_tokens", "ids_sha256", "lossless",
                                                              *["ids"] * with_ids])
        pool.release_unused()                                # the worker may wait long for its next task
    return src.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """The rows with their ids decoded as column ``out``."""
    ship_package(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model))
    at = df.columns.index(ids_col)
    schema = df.select("*", F.lit(None).cast("string").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _encoder(pieces, DROPOUT, SEED, None).merger
        for b in batches:
            texts = [None if x is None else merger.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])
    return df.mapInArrow(run, schema)
