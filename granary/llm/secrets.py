"""Secret scan: plain patterns, and candidates that are confirmed by parsing what they encode.

Base64 and hex runs are decoded; those that parse as a private key's encoding (DER with nested lengths that fit
exactly, or OpenSSH's length-prefixed fields) are reported as ``der`` and ``ssh``; three dotted base64url parts whose
header is a JSON object naming an algorithm, and whose payload is a JSON object, as ``jwt``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "ssh", "jwt")
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", w) for w in _WORDS)
ASSIGN = re.compile(rf"({_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: What a text must hold (in lower case) for the assign pattern to match anywhere.
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: The first line of what may be a DER sequence (0x30, in base64 an M and one of A to P) or an OpenSSH key, in base64.
DER_64 = re.compile(r"(?<![A-Za-z0-9+/])M[A-P][A-Za-z0-9+/]{30,}")
SSH_64 = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]{20,}")
DER_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{60,}")
#: A further line: a line end (also one written as an escape), blanks and base64.
FURTHER = re.compile(r"(?:\\r\\n|\\n|\r\n|[\r\n])[\x20\t]*([A-Za-z0-9+/]+)")
#: Encoded keys are shorter than this; a longer DER length is no key's.
KEY_BYTES = 1 << 16
#: A JSON object starts with a brace, in base64 an e and one of w to z, a digit or a sign.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]+)\.(e[w-z0-9_-][A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)")


def _classes(*members: str) -> bytes:
    return bytes(ord("x") if re.match(members[0], chr(c)) else ord(".") for c in range(256))


_HEX_RUN = (_classes("[0-9a-fA-F]"), b"x" * 32)
_BASE64_RUN = (_classes("[A-Za-z0-9+/]"), b"x" * 32)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _has_run(text: bytes, kind: tuple[bytes, bytes]) -> bool:
    return kind[1] in text.translate(kind[0])


def der_values(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, bytes, list | None]]:
    """(tag, content, children of constructed values) for DER values that fill ``data[at:end]``; ValueError otherwise."""
    end = len(data) if end is None else end
    out = []
    if depth > 12:
        raise ValueError("nested too deeply")
    while at < end:
        if end - at < 2:
            raise ValueError("cut short")
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or end - at < k:
                raise ValueError("bad length")
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 128:
                raise ValueError("length is not the shortest")
        if n > end - at:
            raise ValueError("length runs over")
        out.append((tag, data[at : at + n], der_values(data, at, at + n, depth + 1) if tag & 0x20 else None))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    """Whether the bytes are one PKCS #1, SEC 1 or PKCS #8 private key."""
    try:
        values = der_values(data)
        if len(values) != 1 or values[0][0] != 0x30:
            return False
        inner = values[0][2]
        tags = [v[0] for v in inner]
        if len(tags) >= 9 and tags[:9] == [2] * 9 and inner[0][1] in (b"\0", b"\1"):
            return True
        if tags[:2] == [2, 4] and inner[0][1] == b"\1" and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return True
        if tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\0", b"\1"):
            return inner[1][2][0][0] == 6 and bool(der_values(inner[2][1]))
    except (ValueError, IndexError, TypeError):
        pass
    return False


def der_size(head: bytes) -> int | None:
    """The size that the first 12 bytes of a private key's DER give it: a sequence that begins with version 0 or 1."""
    if len(head) < 12 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    n = int.from_bytes(head[2 : 2 + k], "big") if k else head[1]
    return 2 + k + n if k <= 2 and head[2 + k : 4 + k] == b"\2\1" and head[4 + k] < 2 else None


def ssh_size(data: bytes) -> int | None:
    """How many bytes an OpenSSH private key takes that starts here: magic, then length-prefixed fields; None if it is
    none, 0 if what there is ends before."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at = len(magic)

    def field():
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if len(data) - at < 4 or n > len(data) - at - 4:
            raise ValueError("length runs over")
        at += 4 + n

    try:
        field(), field(), field()
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if not 1 <= n <= 16:
            return None
        for _ in range(n + 1):
            field()
        return at
    except ValueError:
        return 0


def is_private_ssh(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key, which ends where the bytes end."""
    return len(data) > 0 and ssh_size(data) == len(data)


def _unbase64(run: str, url: bool = False) -> bytes | None:
    try:
        return base64.b64decode(run.rstrip("=") + "=" * (-len(run.rstrip("=")) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _wrapped(text: str, first: re.Match, limit: int) -> tuple[str, list[tuple[int, int]]]:
    """Base64 characters from a first line on, over its further lines, and where lines end: (characters, place)."""
    run, ends, n, at = [first[0]], [(len(first[0]), first.end())], len(first[0]), first.end()
    while n < limit and (m := FURTHER.match(text, at)):
        run.append(m[1])
        n, at = n + len(m[1]), m.end()
        ends.append((n, at))
    return "".join(run), ends


def _keys(text: str, start: re.Pattern, size, confirmed) -> list[tuple[int, int]]:
    """Spans of confirmed base64 keys: the encoding gives a key's size, and there a line (or the text) must end.

    A first line whose first bytes give no size is passed at once; another is read up to its size, KEY_BYTES at most.
    """
    out, at = [], 0
    while first := start.search(text, at):
        at = first.end()
        n = size(text, first)
        if not n:
            continue
        need = -(-8 * n // 6)  # characters, without padding
        run, ends = _wrapped(text, first, need)
        end = next((e for k, e in ends if k == need), None)
        if end is not None and confirmed(_unbase64(run[:need]) or b""):
            while text[end : end + 1] == "=" and (need + 1) % 4 != 1:
                end, need = end + 1, need + 1
            out.append((first.start(), end))
            at = end
    return out


def _der_size(text: str, first: re.Match) -> int | None:
    return der_size(_unbase64(first[0][:16]) or b"")


def _ssh_size(text: str, first: re.Match) -> int | None:
    for limit in (1 << 9, 1 << 13, 4 * KEY_BYTES // 3):
        run = _wrapped(text, first, limit)[0]
        n = ssh_size(_unbase64(run[: len(run) // 4 * 4]) or b"")
        n = n if n != 0 else ssh_size(_unbase64(run) or b"")  # a last group of two or three
        if n != 0 or len(run) < limit:
            return n
    return None


def is_signed_token(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads(_unbase64(x, url=True) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in a text, by start, then kind as listed; code points, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = []
    lowered = raw.translate(LOWER)
    if any(h in lowered for h in _HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _has_run(raw, _HEX_RUN):
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
        spans += [("der", *m.span()) for m in DER_HEX.finditer(text) if len(m[0]) % 2 == 0 and is_private_der(bytes.fromhex(m[0]))]
    if _has_run(raw, _BASE64_RUN):
        spans += [("der", *s) for s in _keys(text, DER_64, _der_size, is_private_der)]
        spans += [("ssh", *s) for s in _keys(text, SSH_64, _ssh_size, is_private_ssh)]
    if b".e" in raw:
        spans += [("jwt", *m.span()) for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind: string, start: int, end: int>>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (kind, start, end) for each row of documents.

    A null or empty text has no spans; repeated rows get equal rows; an empty table gives none; a null doc_id stays
    null; other columns are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def joined(spans):
    """kind:start:end of an array of spans, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(scanned: DataFrame, kinds: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """Counts of the base kinds, the base spans' digest and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [count_of(k) for k in kinds]
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
