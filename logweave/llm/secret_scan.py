"""Secret scan with structural confirmation.

Candidates are runs of base64 or hexadecimal characters. One is reported only if its decoded bytes have the
structure of a credential: a DER key (nested tag-length-value fields whose lengths fit exactly), an OpenSSH
private key block (its magic word and length-prefixed fields), or a signed token (two base64url JSON objects and a
signature, with an algorithm in the header). A base64 key ends where the lengths in its own bytes say, so words that
follow it do no harm, and the search goes on right after it. Its lines may be parted by white space, line breaks with indentation, or
escaped line breaks (a literal \\n). Beside them stand three plain kinds (assignment, access key, hex
run), which need no confirmation.

Spans are in code points, end exclusive, of the whole match. Edge cases: null counts as empty; an empty text
has no span; ties (spans of several kinds at one place) are all kept, ordered by start and kind; repeated rows
are scanned alike; other columns pass through.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kinds in listing order; the first three are the plain ones.
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "jwt")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Where a key name stands, in lower case: texts without any hold no assignment.
NAMES = ("passw", "secret", "token", "api")
#: A signed token: header and payload start with the base64 of '{"'.
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
#: Base64 of DER starts with 'M' (a SEQUENCE tag) and of an OpenSSH key with 'b3BlbnNzaC1rZXkt'.
DER64 = re.compile(r"M(?:(?<![A-Za-z0-9+/_-]M)|(?<=\\[nr]M)|(?<=-----M))(?=[A-Za-z0-9+/]{38})")
SSH64 = re.compile(r"b3BlbnNzaC1rZXkt(?=[A-Za-z0-9+/]{23})")
HEX_BLOB = re.compile(r"(?:30|6[fF]70656[eE]7373682[dD]6[bB]65792[dD])[0-9A-Fa-f]{60,}")
ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

#: First bytes of an OpenSSH private key block.
SSH_MAGIC = b"openssh-key-v1\x00"
#: Object identifiers of key algorithms, as DER content bytes: RSA, EC public key, DSA, Ed25519, X25519.
KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2b6570", "2b656e")}


class Bytes:
    """Bytes at hand."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class Armour:
    """Where the base64 characters of a text stand, and which follow each other over gaps.

    It is made once a text, and only where a candidate's first bytes are right. A gap is white space, line breaks and escaped line breaks (a
    literal \\n); for OpenSSH blocks it begins with a line break.
    """

    def __init__(self, text: str):
        self.text = text
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = np.zeros(128, dtype=np.int8)  # 1: base64, 2: space, 3: line break
        low[[ord(c) for c in ALNUM] + [ord("+"), ord("/")]] = 1
        low[[0x20, 0x09]], low[[0x0A, 0x0D]] = 2, 3
        kind = np.where(code < 128, low[np.minimum(code, 127)], 0)
        slash = np.flatnonzero((code[:-1] == 0x5C) & ((code[1:] == 0x6E) | (code[1:] == 0x72)))
        kind[slash] = kind[slash + 1] = 3
        self.at = np.flatnonzero(kind == 1)
        #: Ends of what GAP joins, and of what line breaks join.
        self.ends = np.append(np.flatnonzero(kind == 0), len(text))
        spaced = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
        self.line_ends = np.union1d(self.ends, spaced)

    def after(self, starts: list[int], lines: bool = False) -> tuple[list[int], list[int]]:
        """Places, among all base64 characters, of those at ``starts`` and of the ends of what is joined to each."""
        ends = self.line_ends if lines else self.ends
        stops = ends[np.searchsorted(ends, starts)]
        return np.searchsorted(self.at, starts).tolist(), np.searchsorted(self.at, stops).tolist()

    def chars(self, a: int, b: int) -> str:
        """The base64 characters of these places."""
        at = self.at
        b = min(b, len(at))
        if a < b and at[b - 1] - at[a] == b - 1 - a:
            return self.text[at[a] : at[b - 1] + 1]
        return "".join([self.text[k] for k in at[a:b].tolist()])


class Armoured:
    """The bytes of base64 characters ``first`` to ``stop`` of a text, decoded where they are read."""

    def __init__(self, armour: Armour, first: int, stop: int):
        self.armour, self.first = armour, first
        self.size = (stop - first) * 3 // 4
        self.head = self.decoded(0, 72)

    def read(self, at: int, n: int) -> bytes:
        return self.head[at : at + n] if at + n <= len(self.head) else self.decoded(at, n)

    def decoded(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        skip, a = at % 3, self.first + at // 3 * 4
        chars = self.armour.chars(a, a + -(-(skip + n) // 3) * 4)
        return base64.b64decode(chars + "=" * (-len(chars) % 4))[skip : skip + n] if len(chars) % 4 != 1 else base64.b64decode(chars[:-1])[skip : skip + n]

    def end(self, n: int) -> int:
        """Where in the text the first n bytes end."""
        return int(self.armour.at[self.first + (4 * n + 2) // 3 - 1]) + 1


def der_field(data: Bytes | Armoured, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first byte and end of the content of the field at ``at``; None if its length does not fit before ``end``."""
    head = data.read(at, min(6, end - at))
    if len(head) < 2:
        return None
    size, at = head[1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or 2 + n > len(head):
            return None
        size, at = int.from_bytes(head[2 : 2 + n], "big"), at + n
    return (head[0], at, at + size) if at + size <= end else None


def der_fields(data: Bytes | Armoured, at: int, end: int, most: int) -> list[tuple[int, int, int]] | None:
    """The fields that fill the bytes from ``at`` to ``end`` exactly, ``most`` at most, or None if they don't."""
    out = []
    while at < end:
        field = der_field(data, at, end) if len(out) < most else None
        if field is None:
            return None
        out.append(field)
        at = field[2]
    return out


#: Fields of a private key at most: nine numbers and the further primes of PKCS#1; the other formats have fewer.
KEY_FIELDS = 10


def der_key_size(data: Bytes | Armoured) -> int | None:
    """How many bytes a PKCS#1, PKCS#8 or SEC 1 private key at the beginning fills, by its nested lengths; a public key is no secret.

    Only heads of fields are read, and each as long as those before it fit, so a candidate costs the same whatever lengths it claims.
    """
    outer = der_field(data, 0, data.size)
    if not outer or outer[0] != 0x30:
        return None
    _, at, end = outer
    second = fields = 0
    while at < end:
        field = der_field(data, at, end) if fields < KEY_FIELDS else None
        if field is None:
            return None
        tag, first, at = field
        fields += 1
        if fields == 1 and tag != 0x02:
            return None
        if fields == 2:
            second = tag
            if tag == 0x30:  # PKCS#8: a known algorithm
                named = der_field(data, first, at)
                if not named or named[0] != 0x06 or named[2] - named[1] > 16 or data.read(named[1], named[2] - named[1]) not in KEY_OIDS or der_fields(data, named[2], at, 2) is None:
                    return None
            elif tag == 0x04:  # SEC 1: version 1
                if data.read(outer[1], 3) != b"\x02\x01\x01":
                    return None
            elif tag != 0x02:
                return None
        elif fields == 3 and second == 0x30 and tag != 0x04 or 3 <= fields <= 9 and second == 0x02 and tag != 0x02:
            return None
    whole = fields >= 3 if second == 0x30 else fields >= 9 if second == 0x02 else second == 0x04
    return end if whole else None


def ssh_head(data: Bytes | Armoured) -> tuple[int, int] | None:
    """Where the fields after the head of an OpenSSH private key block begin, and the number of its keys.

    The head is the magic word, then cipher, kdf and kdf options as length-prefixed fields, and the number.
    """
    if data.read(0, len(SSH_MAGIC)) != SSH_MAGIC:
        return None
    at = len(SSH_MAGIC)
    for _ in range(3):
        size = data.read(at, 4)
        if len(size) < 4:
            return None
        at += 4 + int.from_bytes(size, "big")
    n = data.read(at, 4)
    return (at + 4, int.from_bytes(n, "big")) if len(n) == 4 and any(n) else None


def ssh_size(data: Bytes | Armoured, at: int, keys: int) -> int | None:
    """How many bytes the block fills, public keys and private part included; None if they don't fit."""
    for _ in range(keys + 1):
        size = data.read(at, 4)
        if len(size) < 4:
            return None
        at += 4 + int.from_bytes(size, "big")
        if at > data.size:
            return None
    return at


def is_jwt(text: str) -> bool:
    parts = text.split(".")
    if len(parts) != 3 or not parts[2]:
        return False
    try:
        raw = [base64.urlsafe_b64decode(p + "=" * (-len(p) % 4)) for p in parts[:2]]
        if not all(r.rstrip().endswith(b"}") for r in raw):
            return False
        head, body = map(json.loads, raw)
    except (ValueError, RecursionError):  # no base64, no JSON, or JSON too deep to be a token's
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def confirmed(data: bytes) -> str | None:
    """Kind of key that fills the bytes, or that they begin with (OpenSSH)."""
    return "der_key" if der_key_size(Bytes(data)) == len(data) else "ssh_key" if ssh_head(Bytes(data)) else None


def opens(text: str, at: int, joined: frozenset[str] | None = None, dashes: bool = False) -> bool:
    """Whether no character that could belong to the candidate at ``at`` stands before it; an escaped line break may."""
    before = text[at - 1 : at]
    return not before or before not in (joined or ALNUM) or text[at - 2 : at] in ("\\n", "\\r") or dashes and text[at - 5 : at] == "-----"


TOKEN_CHARS, KEY_CHARS = ALNUM | {"_", "-"}, ALNUM | {"+", "/", "_", "-"}


def keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in base64: kind, start and end; padding belongs to them, and the search goes on behind each.

    A key with a wrong length costs reading a few heads. An OpenSSH block ends where its fields do, or with the lines that follow if they do
    not fit; what it is read for is then behind the search. So the work is in proportion to the text.
    """
    found = sorted([(m.start(), False) for m in DER64.finditer(text)] + [(m.start(), True) for m in SSH64.finditer(text)])
    likely = []
    for at, ssh in found:
        if not opens(text, at, KEY_CHARS, True):
            continue
        if not ssh:
            head = base64.b64decode(text[at : at + 12])
            n = head[1] & 0x7F if head[1] & 0x80 else 0
            if head[0] != 0x30 or head[1] == 0x80 or n > 4 or head[2 + n] != 0x02:
                continue
        likely.append((at, ssh))
    if not likely:
        return
    armour, upto = Armour(text), 0
    starts = [at for at, _ in likely]
    for (at, ssh), first, stop, _, line_stop in zip(likely, *armour.after(starts), *armour.after(starts, lines=True)):
        if at < upto:
            continue
        data = Armoured(armour, first, stop)
        if ssh:
            told = ssh_head(Armoured(armour, first, line_stop))
            if not told:
                continue
            size = ssh_size(data, *told)
            end = data.end(size) if size is not None else int(armour.at[line_stop - 1]) + 1
        else:
            size = der_key_size(data)
            if size is None:
                continue
            end = data.end(size)
        end += len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
        yield "ssh_key" if ssh else "der_key", at, end
        upto = end


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind in listing order."""
    spans = []
    low = text.lower()
    if any(n in low for n in NAMES):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans += [("jwt", *m.span()) for m in JWT.finditer(text) if opens(text, m.start(), TOKEN_CHARS) and is_jwt(m[0])]
    spans += keys(text)
    for m in HEX_BLOB.finditer(text):
        if len(m[0]) % 2 == 0 and opens(text, m.start()) and text[m.end() : m.end() + 1] not in ALNUM and (kind := confirmed(bytes.fromhex(m[0]))):
            spans.append((kind, *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_secrets(docs: DataFrame, spans_col: str = "spans") -> DataFrame:
    """``docs`` with the spans of each whole text; a column of that name is replaced."""
    keep = [c for c in docs.columns if c != spans_col]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(spans_col, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, spans_col])

    return docs.select(*keep).mapInArrow(add, schema)
