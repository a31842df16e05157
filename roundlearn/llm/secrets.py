"""Secret scan with structural confirmation.

Base patterns (assignments, access keys, long hex runs) are reported as they
stand. Further candidates, runs of base64 or hex characters, PEM blocks and
three-part signed tokens, are reported only if their structure confirms them
(line breaks may be real ones or escaped as in JSON strings; consecutive lines
of base64 are joined): they decode, and the bytes are a DER key (nested tag lengths that end where
their parents do, around a key's version, algorithm or modulus), an OpenSSH
key (magic and length-prefixed fields that fill the block), or the first part
is a JSON header that names a signature algorithm. The bytes of a PEM block
with encryption headers have no structure of their own; whole cipher blocks
confirm them.

Cases: a null text counts as empty, without spans; a text of any length is
scanned whole; a null id is kept as null; equal rows give equal rows; an empty
table gives no rows. Spans are code point offsets, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundlearn.llm.common import by_batch

# The base patterns and their least lengths are fixed values.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "signed_token", "pem_key", "der_key", "ssh_key")
ORDER = {k: i for i, k in enumerate(KINDS)}

_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----")
_KEY_NAME = re.compile(r"(?:[A-Z0-9 ]*PRIVATE KEY|[A-Z0-9 ]*PUBLIC KEY)")
_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\++[nrt/])*+")
_ESCAPED = re.compile(r"(?<!\\)\\++[nrt]")
_SLASH = re.compile(r"(?<!\\)\\++/")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:[ \t]*[\r\n]+[ \t]*[A-Za-z0-9+/_-]++)+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_RUN64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_RUNHEX = re.compile(r"[0-9A-Fa-f]{64,}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_MAGIC = b"openssh-key-v1\x00"
_SSH_HEAD = re.compile(rb"\x00\x00\x00.(?:ssh|ecdsa|sk)-", re.S)
_ALGS = re.compile(r"(?:HS|RS|ES|PS)(?:256|384|512)|EdDSA|none")


def _from_base64(s: str) -> bytes | None:
    s = s.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class _Bytes:
    """Bytes that are read here and there: given ones, or those that base64
    characters stand for, of which only what is read is decoded."""

    def __init__(self, given: bytes | None = None, chars: str = "", first: int = 0, last: int = 0):
        self.given, self.chars, self.first = given, chars, first
        self.size = len(given) if given is not None else (last - first) * 3 // 4

    def read(self, at: int, n: int) -> bytes:
        if self.given is not None:
            return self.given[at:at + n]
        n = min(n, self.size - at)
        part = self.chars[self.first + at // 3 * 4:self.first + -(-(at + n) // 3) * 4]
        return (_from_base64(part) or b"")[at % 3:at % 3 + n]


#: Of a sequence with more values no key is known.
MOST_ITEMS = 16


def der_items(b: _Bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of a sequence of DER values that fills ``b`` from
    ``at`` to ``end``; their contents are not read."""
    out = []
    while at < end:
        head = b.read(at, 6)
        if at + 2 > end or len(head) < 2 or len(out) == MOST_ITEMS:
            return None
        n, at = head[1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > end or head[2] == 0:
                return None
            n, at = int.from_bytes(head[2:2 + size], "big"), at + size
            if n < 0x80:
                return None
        if at + n > end:
            return None
        out.append((head[0], at, at + n))
        at += n
    return out


def is_der_key(b: _Bytes) -> bool:
    """True for the DER forms of private and public keys: every nested length
    ends where its parent does."""
    top = der_items(b, 0, b.size)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(b, *top[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags, size = [t for t, _, _ in inner], [z - a for _, a, z in inner]
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and size[0] == 1 and size[1] >= 32:
        return True                                        # version, modulus, exponents, primes ...
    if tags[:3] == [0x02, 0x30, 0x04] and size[0] == 1:
        alg = der_items(b, *inner[1][1:])                  # version, algorithm, key octets
        return bool(alg) and alg[0][0] == 0x06
    if tags[:2] == [0x02, 0x04] and size[0] == 1 and b.read(inner[0][1], 1) == b"\x01" and size[1] >= 20:
        return True                                        # curve key: version 1, scalar
    if tags == [0x02] * 6 and size[0] == 1 and size[1] >= 64:
        return True                                        # DSA key: version, p, q, g, public and private number
    if tags == [0x30, 0x04] and size[1] >= 24:
        alg = der_items(b, *inner[0][1:])                  # encrypted key: algorithm with parameters, octets
        return bool(alg) and [t for t, _, _ in alg] == [0x06, 0x30]
    if tags == [0x30, 0x03]:
        alg = der_items(b, *inner[0][1:])                  # algorithm, key bits
        return bool(alg) and alg[0][0] == 0x06 and size[1] >= 30
    return tags == [0x02, 0x02] and size[0] >= 64 and 1 <= size[1] <= 8


def ssh_ends(b: _Bytes) -> list[int]:
    """Where an OpenSSH private key block (one place), or a public key blob
    (the end of each of its fields) that starts with ``b`` can end, by its
    length-prefixed fields; empty if neither starts there."""
    def end_of(at: int) -> int | None:
        if at + 4 > b.size:
            return None
        end = at + 4 + int.from_bytes(b.read(at, 4), "big")
        return end if end <= b.size else None

    if b.read(0, len(_MAGIC)) == _MAGIC:
        at = len(_MAGIC)
        for _ in range(3):                                 # cipher, kdf, kdf options
            if (at := end_of(at)) is None:
                return []
        n, at = int.from_bytes(b.read(at, 4), "big"), at + 4
        if not 1 <= n <= 64:
            return []
        for _ in range(n + 1):                             # public keys, private block
            if (at := end_of(at)) is None:
                return []
        return [at]
    at = end_of(0)
    if at is None or at > 50 or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,40}", b.read(4, at - 4)):
        return []
    out = []
    while len(out) < 2 * MOST_ITEMS and (at := end_of(at)) is not None:
        out.append(at)
    return out


def is_token_header(part: str) -> bool:
    b = _from_base64(part)
    if not b or not b.startswith(b"{"):
        return False
    try:
        head = json.loads(b)
    except (ValueError, RecursionError):                   # no JSON, or nested deeper than any header
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and bool(_ALGS.fullmatch(head["alg"]))


def _key_kind(b: _Bytes | bytes | None) -> str | None:
    if not b:
        return None
    b = _Bytes(b) if isinstance(b, bytes) else b
    return "ssh_key" if b.size in ssh_ends(b) else "der_key" if is_der_key(b) else None


def is_pem_key(body: str) -> bool:
    """True if the text between PEM marks holds a key."""
    body = _SLASH.sub("/", _ESCAPED.sub(" ", body))
    raw = _from_base64("".join(x for x in body.split() if ":" not in x and "," not in x))
    if raw and "Proc-Type:" in body and "ENCRYPTED" in body:
        return len(raw) >= 16 and len(raw) % 8 == 0
    return _key_kind(raw) is not None


def _der_chars(head: bytes) -> int:
    """Base64 characters, without padding, of the DER sequence that starts
    with ``head``; 0 if none does."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    size = head[1] & 0x7F if head[1] & 0x80 else 0
    if size > 4 or head[1] == 0x80:
        return 0
    n = 2 + size + (int.from_bytes(head[2:2 + size], "big") if size else head[1])
    return -(-n * 4 // 3)


def pem_keys(text: str) -> list[tuple[int, int, int]]:
    """Spans from a BEGIN mark to its END mark, before the next BEGIN."""
    out, marks = [], list(_BEGIN.finditer(text))
    for i, m in enumerate(marks):
        if not _KEY_NAME.fullmatch(m[1]):
            continue
        last = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        mark = f"-----END {m[1]}-----"
        end = text.find(mark, m.end(), last)
        if end >= 0 and _BODY.fullmatch(text, m.end(), end) and is_pem_key(text[m.end():end]):
            out.append((m.start(), ORDER["pem_key"], end + len(mark)))
    return out


def wrapped_keys(text: str) -> list[tuple[int, int, int]]:
    """Spans of keys over consecutive lines of base64, from any line on. Of a
    candidate only the lengths in it are read, so the work is linear in the
    lines whatever they hold."""
    out = []
    for m in _LINES.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        chars = "".join([text[a:e] for a, e in lines])
        ends = list(accumulate(e - a for a, e in lines))            # characters up to each line's end
        width = [e - a for a, e in lines]
        alike = list(range(len(lines)))                             # the line after the last one as long, if there is one
        for i in range(len(lines) - 2, -1, -1):
            alike[i] = alike[i + 1] if width[i] == width[i + 1] else i + 1
        i = 0
        while i < len(lines) - 1:
            first = ends[i] - width[i]
            head = _from_base64(chars[first:first + 40]) or b""
            k = i                                                   # the last line of a key
            if need := _der_chars(head):
                j = bisect_left(ends, need + first)
                if j < len(lines) and ends[j] == need + first and is_der_key(_Bytes(None, chars, first, ends[j])):
                    k = j
            elif head.startswith(_MAGIC) or _SSH_HEAD.match(head):
                j = alike[i]
                for z in (j, j - 1) if j > i + 1 else (j,):         # the last line may be text
                    b = _Bytes(None, chars, first, ends[z])
                    if (ends[z] - first) % 4 != 1 and b.size in ssh_ends(b):
                        k = z
                        break
            if k > i:
                end = lines[k][1]
                end += len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))
                out.append((lines[i][0], ORDER["der_key" if need else "ssh_key"], end))
            i = k + 1
    return out


def scan(text: str | None) -> tuple[list, list]:
    """(base spans, all spans) of one text, each (start, kind order, end)."""
    if not text:
        return [], []
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = []
    if "-----BEGIN " in text:
        more += pem_keys(text)
    if text.count(".") >= 2 and "." in text:
        more += [(m.start(), ORDER["signed_token"], m.end()) for m in _SIGNED.finditer(text)
                 if m[1].startswith(("ey", "ew")) and is_token_header(m[1])] if "ey" in text or "ew" in text else []
    for m in _RUNHEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
            more.append((m.start(), ORDER[kind], m.end()))
    pems = [(a, e) for a, k, e in more if k == ORDER["pem_key"]]
    # escaped breaks as real ones, every offset kept
    plain = _ESCAPED.sub(lambda m: "\n" * len(m[0]), text) if "\\" in text else text
    if "\n" in plain or "\r" in plain:
        more += [x for x in wrapped_keys(plain) if not any(a <= x[0] and x[2] <= e for a, e in pems)]
    for m in _RUN64.finditer(plain):
        if kind := _key_kind(_from_base64(m[0])):
            more.append((m.start(), ORDER[kind], m.end()))
    base.sort()
    return base, sorted(base + more)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = ("doc_id {id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "span_list array<struct<kind:string,start:int,end:int>>")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans
    as text and as a list."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan(t) for t in b.column(1).to_pylist()]
        n = [[sum(k == i for _, k, _ in base) for base, _ in found] for i in range(3)]
        return pa.RecordBatch.from_arrays([
            b.column(0), *[pa.array(x, pa.int64()) for x in n],
            pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
            pa.array([_joined(spans) for _, spans in found], pa.string()),
            pa.array([[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in spans] for _, spans in found],
                     pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "span_list"])
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return by_batch(src, run, SCHEMA.format(id=src.schema[0].dataType.simpleString()))


def redacted(text: str | None, spans: list) -> str | None:
    """The text with every span, overlapping ones as one, put as [kind]."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, k, e = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e, i = max(e, spans[i][2]), i + 1
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = e
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with their secrets put as [kind]; all other columns are as
    they were, but for the length column where a text changed."""
    at = df.columns.index(text_col)
    len_at = df.columns.index(length_col) if length_col in df.columns else None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        old = b.column(at).to_pylist()
        new = [redacted(t, scan(t)[1]) for t in old]
        cols = list(b.columns)
        cols[at] = pa.array(new, b.schema.field(at).type)
        if len_at is not None:
            changed = pa.array([x != y for x, y in zip(old, new, strict=True)])
            lengths = pc.cast(pc.utf8_length(cols[at]), b.schema.field(len_at).type)
            cols[len_at] = pc.if_else(changed, lengths, cols[len_at])
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return by_batch(df, run, df.schema)
