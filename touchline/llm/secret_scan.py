"""Secret scan with structural confirmation.

Pattern matches give base findings: assignments, access ids, long hex runs. Beyond them, base64 and hex candidates
are decoded and reported only if their bytes parse: DER keys whose nested lengths all close, OpenSSH keys whose
length-prefixed strings fill the body, signed tokens whose header and payload are JSON and whose signature has
the length that the named algorithm gives.

Keys may be wrapped: a candidate starts at a token of digits whose first bytes open a DER sequence or an OpenSSH key, and
its own length says how many digits belong to it. They are gathered over line ends (also escaped, as in JSON and env
files), blanks, quotes and comment marks, so lines may be indented, of any width, and stand next to other encoded lines.
A start reads at most `MOST_KEY` bytes.

Null or empty text has no findings. Repeated rows are each scanned. Nothing depends on other columns. Finding
positions are code points, end exclusive. Work is linear in the text, one row at a time.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from touchline.llm.common import arrow_rows, replace_text

#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "jwt", "private_key", "openssh_key")

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the length can stand in the pattern
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Where a key can start: first digits of a DER sequence or of the OpenSSH magic, at the beginning of a token.
DER_START = re.compile(r"M[A-I](?:(?<![A-Za-z0-9+/_]M[A-I])|(?<=\\[nrt]M[A-I]))")
OPENSSH_START = re.compile(r"b3BlbnNz(?:(?<![A-Za-z0-9+/_]b3BlbnNz)|(?<=\\[nrt]b3BlbnNz))")
HEX_START = re.compile(r"30(?<![0-9A-Za-z]30)")
DIGITS64, DIGITS16 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
GOES_ON64, GOES_ON16 = re.compile(r"[A-Za-z0-9+/_]"), re.compile(r"[0-9A-Za-z]")
#: What may stand between the digits of one key: white space, escaped line ends, quotes, comment and joining marks.
BETWEEN = re.compile(r"""(?:\s|\\+[nrt]|\\(?=\s)|["'`#*>|,;:&]|\+(?<=["'\s]\+)(?=["'\s])){1,64}""")
LEAST_KEY, MOST_KEY = 24, 65_539  # bytes
MAGIC = b"openssh-key-v1\0"
#: Signature bytes by algorithm; RSA signatures have the key's length.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """DER elements (tag, content start, content end) that fill start..end exactly, else None."""
    found = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size = data[start], data[start + 1]
        start += 2
        if size >= 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or start + count > end or data[start] == 0:
                return None
            size = int.from_bytes(data[start:start + count], "big")
            if size < 0x80:
                return None  # DER takes the short form there
            start += count
        if start + size > end:
            return None
        found.append((tag, start, start + size))
        start += size
    return found


def der_key(data: bytes) -> str | None:
    """Name of the private key encoding that these bytes are in full, else None."""
    top = _elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return None
    parts = _elements(data, top[0][1], top[0][2])
    if not parts:
        return None
    tags = [p[0] for p in parts]
    value = lambda p: int.from_bytes(data[p[1]:p[2]], "big")
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:
        inner = _elements(data, parts[0][1], parts[0][2])
        return "pkcs8-encrypted" if inner and inner[0][0] == OID and parts[1][2] - parts[1][1] >= 16 else None
    if tags[0] != INTEGER or parts[0][2] - parts[0][1] != 1 or value(parts[0]) > 1:
        return None
    if tags[1:3] == [SEQUENCE, OCTETS]:
        inner = _elements(data, parts[1][1], parts[1][2])
        if not inner or inner[0][0] != OID:
            return None
        key = data[parts[2][1]:parts[2][2]]
        nested = _elements(key, 0, len(key))
        return "pkcs8" if nested and len(nested) == 1 and nested[0][0] in (SEQUENCE, OCTETS, INTEGER) else None
    if set(tags) == {INTEGER} and len(tags) == 9 and value(parts[1]).bit_length() >= 512:
        product = value(parts[4]) * value(parts[5])
        return "pkcs1" if product == value(parts[1]) else None
    if set(tags) == {INTEGER} and len(tags) == 6 and value(parts[1]).bit_length() >= 512:
        return "dsa"
    if value(parts[0]) == 1 and tags[1] == OCTETS and all(t in (0xA0, 0xA1) for t in tags[2:]) and 16 <= parts[1][2] - parts[1][1] <= 72:
        return "sec1"
    return None


def openssh_key(data: bytes) -> bool:
    """True for an OpenSSH private key whose length-prefixed strings fill the bytes."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)

    def string(at: int) -> int:
        if at + 4 > len(data):
            return -1
        end = at + 4 + int.from_bytes(data[at:at + 4], "big")
        return end if end <= len(data) else -1

    for _ in range(3):  # cipher, key derivation, its options
        if (at := string(at)) < 0:
            return False
    keys = int.from_bytes(data[at:at + 4], "big") if at + 4 <= len(data) else 0
    at += 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):  # public keys, private block
        if (at := string(at)) < 0:
            return False
    return at == len(data)


def _base64(text: str) -> bytes | None:
    text = text.translate({45: "+", 95: "/"}).rstrip("=")
    try:
        return binascii.a2b_base64(text + "=" * (-len(text) % 4), strict_mode=True)
    except binascii.Error:
        return None


def signed_token(text: str) -> bool:
    """Header and payload decode to JSON objects, the header names an algorithm, the signature fits it."""
    parts = [_base64(p) for p in text.split(".")]
    if None in parts or len(parts) != 3:
        return False
    try:
        header, payload = (json.loads(p) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    size = len(parts[2])
    if header["alg"] in SIGNATURE:
        return size == SIGNATURE[header["alg"]]
    return size >= 128 if header["alg"][:2] in ("RS", "PS") else header["alg"] == "none" and size == 0


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "private_key" if der_key(data) else "openssh_key" if openssh_key(data) else None


def _gather(text: str, at: int, size: int, digits: re.Pattern) -> tuple[str, int] | None:
    """`size` digits from a place on, with what stands between left out, and the place after the last one."""
    parts = []
    while run := digits.match(text, at):
        taken = min(size, run.end() - at)
        parts.append(text[at:at + taken])
        at, size = at + taken, size - taken
        if not size:
            return "".join(parts), at
        if not (gap := BETWEEN.match(text, at)):
            return None
        at = gap.end()
    return None


class _Candidate:
    """Bytes written in base64 or hex digits from a place on; no more is read than is asked for."""

    def __init__(self, text: str, start: int, hexadecimal: bool = False):
        self.text, self.start, self.hexadecimal = text, start, hexadecimal

    def _digits(self, size: int) -> tuple[str, int] | None:
        wanted = size * 2 if self.hexadecimal else -(-size * 4 // 3)
        return _gather(self.text, self.start, wanted, DIGITS16 if self.hexadecimal else DIGITS64)

    def read(self, size: int) -> bytes | None:
        found = self._digits(size) if size <= MOST_KEY else None
        data = found and (bytes.fromhex(found[0]) if self.hexadecimal else _base64(found[0] + "A" * (len(found[0]) % 4 == 1)))
        return data[:size] if data and len(data) >= size else None

    def end(self, size: int) -> int | None:
        """The place after the digits of `size` bytes and their padding; None if the token goes on there."""
        _, at = self._digits(size)
        for _ in range(0 if self.hexadecimal else -size % 3):
            gap = BETWEEN.match(self.text, at)
            pad = at if self.text[at:at + 1] == "=" else gap.end() if gap and self.text[gap.end():gap.end() + 1] == "=" else None
            if pad is None:
                break
            at = pad + 1
        return None if (GOES_ON16 if self.hexadecimal else GOES_ON64).match(self.text, at) else at


def _der_size(data: bytes | None) -> int:
    """Length of the DER sequence that opens with these ten bytes, 0 if no key starts so: its first element is a version of 0 or 1
    with a further element behind it, or a sequence that begins with an object identifier."""
    if not data or data[0] != SEQUENCE or data[1] > 0x82 or data[1] == 0x80:
        return 0
    head = 2 + max(0, data[1] - 0x80)
    size = head + (int.from_bytes(data[2:head], "big") if head > 2 else data[1])
    version = data[head:head + 2] == bytes([INTEGER, 1]) and data[head + 2] <= 1 and data[head + 3] in (INTEGER, SEQUENCE, OCTETS)
    named = data[head] == SEQUENCE and OID in data[head + 2:head + 5]
    return size if (version or named) and size >= LEAST_KEY else 0


def _openssh_size(key: _Candidate) -> int:
    """Length of the OpenSSH key that starts there, by its length-prefixed strings; 0 if there is none."""
    at = len(MAGIC)
    if key.read(at) != MAGIC:
        return 0
    keys, strings = 0, 3  # cipher, key derivation, its options; then public keys and the private block
    while strings:
        head = key.read(at + 4)
        if head is None:
            return 0
        at, strings = at + 4 + int.from_bytes(head[at:], "big"), strings - 1
        if not strings and not keys:
            head = key.read(at + 4)
            keys = int.from_bytes(head[at:], "big") if head else 0
            if not 1 <= keys <= 64:
                return 0
            at, strings = at + 4, keys + 1
    return at


def _keys(text: str) -> list[tuple[str, int, int]]:
    """Private keys in base64 or hex digits, each from its start to the end that its own lengths give; after a key the search
    goes on behind it."""
    found = []
    for start, size_of, hexadecimal in ((DER_START, None, False), (OPENSSH_START, _openssh_size, False), (HEX_START, None, True)):
        upto = 0
        for m in start.finditer(text):
            if m.start() < upto:
                continue
            key = _Candidate(text, m.start(), hexadecimal)
            size = size_of(key) if size_of else _der_size(key.read(10))
            data = key.read(size) if size else None
            if (kind := _key_kind(data)) and (end := key.end(size)) is not None:
                found.append((kind, m.start(), end))
                upto = end
    return found


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind order."""
    if not text:
        return []
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    spans += [("jwt", m.start(), m.end()) for m in TOKEN.finditer(text) if signed_token(m[0])]
    spans += _keys(text)
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str) -> str:
    """Text with each run of overlapping findings replaced by its first kind in brackets."""
    out, at, kind, upto = [], 0, None, 0
    for k, start, end in find_secrets(text):
        if kind is not None and start < upto:
            upto = max(upto, end)
            continue
        if kind is not None:
            out.append(f"[{kind}]")
            at = upto
        out.append(text[at:start])
        kind, upto = k, end
    if kind is not None:
        out.append(f"[{kind}]")
        at = upto
    return "".join(out) + text[at:]


def scan(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per input row: the key and its findings, in order."""
    def rows(source):
        for ident, text in source:
            yield ident, [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(text)]

    kind = df.schema[key].dataType.simpleString()
    return arrow_rows(df.select(key, column), f"`{key}` {kind}, findings array<struct<kind:string,start:long,end:long>>", rows)


def redacted(df: DataFrame, column: str = "text") -> DataFrame:
    """The same rows with secrets cut out of the text."""
    return replace_text(df, redact, column)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from findings."""
    def rows(source):
        for ident, findings in source:
            told = [(f["kind"], f"{f['kind']}:{f['start']}:{f['end']}") for f in findings]
            base = [(k, t) for k, t in told if k in KINDS[:3]]
            counts = [sum(k == kind for k, _ in base) for kind in KINDS[:3]]
            yield (ident, *counts, hashlib.sha256(",".join(t for _, t in base).encode()).hexdigest(), ",".join(t for _, t in told), len(told) - len(base))

    return arrow_rows(scan(df), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long", rows)
