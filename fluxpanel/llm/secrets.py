"""Secret scans: patterns first, then structural confirmation.

Three pattern kinds (assign, access, hex) are reported as they stand.  Further kinds are
reported only if their structure holds once decoded: a base64 or hex run that is a DER key
(nested lengths fill it exactly) or an OpenSSH key (length-prefixed fields), a PEM block
whose body is one of these, and a signed token whose header and payload are JSON objects
and whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern kinds, their patterns and least lengths.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: In the order in which kinds stand where they start at one place.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE = KINDS[:3]

_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_RUN, _B64_RUN = b"h" * 24, b"b" * 40
_AS_HEX = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
_AS_B64 = bytes(98 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 46 for c in range(256))
#: A run of base64, which may go on over lines.
_B64 = re.compile(rb"[A-Za-z0-9+/_-]{40,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{4,})*")
_HEX_ANY = re.compile(rb"[0-9A-Fa-f]{64,}")
#: Three parts, of which the first, a JSON object, begins with a brace and a quote or white space somewhere.
_JWT = re.compile(rb"([A-Za-z0-9_-]{12,})\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{2,}")
_JWT_HEAD = re.compile(rb"e[wy]")
_KEY_HEAD = re.compile(rb"M|b3BlbnNzaC1rZXktdjEA")
_NOT_B64 = re.compile(rb"\s+")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_DEPTH = 12


def decoded(run: bytes) -> bytes | None:
    """Base64 in either alphabet, padded or not; null if it can't be."""
    body = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_nodes(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """(tag, content or inner nodes) of DER that fills ``data`` exactly; null if lengths don't nest."""
    nodes, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > _DEPTH:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 0x80 or data[at] == 0:
                return None  # not the shortest form
            at += k
        if at + n > len(data):
            return None
        inner = data[at : at + n]
        if tag & 0x20:
            inner = der_nodes(inner, depth + 1)
            if inner is None:
                return None
        nodes.append((tag, inner))
        at += n
    return nodes


def is_der_key(data: bytes) -> bool:
    """PKCS#1 (nine integers), SEC1 (version 1 and an octet string) or PKCS#8 (algorithm and octet string)."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    nodes = der_nodes(data)
    if not nodes or len(nodes) != 1:
        return False
    inner = nodes[0][1]
    tags = [tag for tag, _ in inner]
    if not inner or tags[0] != 0x02 or inner[0][1] not in (b"\0", b"\1"):
        return False
    if tags[:9] == [0x02] * 9:
        return all(content for _, content in inner[:9])
    if len(tags) > 1 and inner[0][1] == b"\1" and tags[1] == 0x04 and len(inner[1][1]) >= 16:
        return True
    return len(tags) > 2 and tags[1] == 0x30 and tags[2] == 0x04 and bool(inner[1][1]) and inner[1][1][0][0] == 0x06 and len(inner[2][1]) >= 16


def ssh_length(data: bytes) -> int:
    """Bytes of the OpenSSH key that ``data`` begins with, or 0.

    The magic, three length-prefixed fields, a count of keys, and that many public keys and one
    private part, each with its length.
    """
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at = len(magic)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) else 0


def is_ssh_key(data: bytes) -> bool:
    return ssh_length(data) == len(data) > 0


def der_length(head: bytes) -> int:
    """Bytes of the DER sequence that begins with ``head`` (six bytes), by its own header; 0 if it isn't one."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    n = head[1]
    if n < 0x80:
        return 2 + n
    k = n & 0x7F
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 else 0


def keys_in_base64(run: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the keys whose base64 stands anywhere in ``run``, also behind a prefix or before more text."""
    out, at = [], 0
    while m := _KEY_HEAD.search(run, at):
        at, end = m.start(), 0
        if m[0] == b"M":
            size = der_length(decoded(run[at : at + 8]) or b"")
            chars = -(-size * 4 // 3)
            if size >= 24 and at + chars <= len(run) and is_der_key((decoded(run[at : at + chars]) or b"")[:size]):
                end, kind = at + chars, "der"
        else:
            rest = run[at:]
            size = ssh_length(decoded(rest[: len(rest) - (len(rest) % 4 == 1)]) or b"")
            if size:
                end, kind = at + -(-size * 4 // 3), "ssh"
        if end:
            out.append((at, end, kind))
        at = end or at + 1
    return out


def keys_in_hex(run: bytes) -> list[tuple[int, int, str]]:
    """The same for hexadecimal digits."""
    out, at = [], 0
    low = run.lower()
    while True:
        found = [i for i in (low.find(b"30", at), low.find(b"6f70656e737368", at)) if i >= 0]
        if not found:
            return out
        at = min(found)
        data = binascii.unhexlify(run[at : at + (len(run) - at) // 2 * 2])
        size = der_length(data[:6])
        kind = "der" if 24 <= size <= len(data) and is_der_key(data[:size]) else "ssh"
        size = size if kind == "der" else ssh_length(data)
        if size:
            out.append((at, at + 2 * size, kind))
        at += max(1, 2 * size)


def is_signed_token(token: bytes) -> bool:
    header, payload, signature = token.split(b".")
    if not signature or decoded(signature) is None:
        return False
    for part, names in ((header, ("alg",)), (payload, ())):
        data = decoded(part)
        try:
            value = json.loads(data) if data is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or not all(isinstance(value.get(n), str) for n in names):
            return False
    return True


def key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def byte_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) in bytes."""
    out = []
    low = raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    if _HEX_RUN in raw.translate(_AS_HEX):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    blocks = []
    if b"PRIVATE KEY-----" in raw:
        blocks = [m.span() for m in _PEM.finditer(raw) if key_kind(decoded(b"".join(m[2].split())))]
        out += [(a, b, KINDS.index("pem")) for a, b in blocks]
    if _B64_RUN in raw.translate(_AS_B64):
        found = []
        for m in _B64.finditer(raw):
            run = m[0]
            places = None
            if _NOT_B64.search(run):  # over lines: where each letter stands
                places = [i for i, c in enumerate(run) if c not in b" \t\r\n"]
                run = bytes(run[i] for i in places)
            for a, b, kind in keys_in_base64(run):
                start, end = (a, b) if places is None else (places[a], places[b - 1] + 1)
                end += m.start()
                while end < len(raw) and raw[end] == 61 and (end - m.end() < 2):
                    end += 1
                found.append((m.start() + start, end, KINDS.index(kind)))
        for m in _HEX_ANY.finditer(raw):
            found += [(m.start() + a, m.start() + b, KINDS.index(kind)) for a, b, kind in keys_in_hex(m[0])]
        out += [s for s in found if not any(a <= s[0] and s[1] <= b for a, b in blocks)]
    if b"ey" in raw or b"ew" in raw:
        for m in _JWT.finditer(raw):
            for head in _JWT_HEAD.finditer(m[1]):
                if is_signed_token(raw[m.start() + head.start() : m.end()]):
                    out.append((m.start() + head.start(), m.end(), KINDS.index("jwt")))
                    break
    return sorted(set(out), key=lambda s: (s[0], s[2], s[1]))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind; nothing for a null text."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    found = byte_spans(raw)
    if not found or len(raw) == len(text):
        return [(KINDS[k], a, b) for a, b, k in found]
    place, at, points = {}, 0, 0
    for byte in sorted({x for a, b, _ in found for x in (a, b)}):
        points += len(raw[at:byte].decode("utf-8", "surrogatepass"))
        place[byte], at = points, byte
    return [(KINDS[k], place[a], place[b]) for a, b, k in found]


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the spans of each whole text as an array of (kind, start, end); no shuffle.

    A null or empty text has none, a text of any length is scanned whole.  A column of ``docs``
    with the output's name is replaced; repeated rows stay; an empty table gives no rows.
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in part], dtype=object)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], scanned(F.col(text_col)).alias(out))


def summary(found: str = "secrets") -> dict:
    """Columns that count and write the spans of ``scan``."""
    kept = lambda kinds: F.filter(F.col(found), lambda s: s["kind"].isin(*kinds))
    write = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = {f"n_{k}": F.size(kept([k])).cast("long") for k in BASE}
    return counts | {"base_sha256": F.sha2(write(kept(BASE)).cast("binary"), 256), "spans": write(F.col(found))}


def sha256_of(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(written([s for s in found if s[0] in BASE]).encode()).hexdigest()
