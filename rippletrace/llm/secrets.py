"""Secret scan with structural confirmation.

Patterns propose spans. Candidates that look like base64 or hexadecimal data
are then decoded and parsed: DER key encodings must have nested lengths that
fit down to the leaves and the shape of a private key, private keys in the wire format of SSH must hold whole length-prefixed
fields, and signed tokens must have a JSON header that names an algorithm.
Only what parses is added; the spans of the plain patterns always stay.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rippletrace.llm.common import add_columns, free_name

#: The plain patterns, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
BASE_KINDS = KINDS[:3]

# Letters of the keywords match in either case, and only ASCII ones: without
# re.ASCII a long s or the Kelvin sign would match as well.
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run shorter than the minimum can hold no match that starts later in it and
# is long enough, so the minimum may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
_HINTS = ("passw", "secret", "token", "api")

_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{16,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
# Base64 may be wrapped into lines, also by an escaped line break as in JSON
# strings; the lines of a run have to be long, but for the last. The letter of an
# escape before a run isn't part of it.
_WRAP = r"(?:(?:\r?\n|(?:\\+r)?\\+n)[ \t]*)"
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:(?<=\\)[nrt])?((?:[A-Za-z0-9+/]{40,}%s)*[A-Za-z0-9+/]{40,}(?:%s[A-Za-z0-9+/]+)?)={0,2}" % (_WRAP, _WRAP))
_LINE = re.compile(r"((?:\\+r)?\\+n|\s)+|[A-Za-z0-9+/]+")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")


def _der(data: bytes | Decoded, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at ``at``, if its length fits into ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= end else None


#: The object identifiers under which keys are encrypted with a password.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


class Decoded:
    """The bytes of base64 letters without padding; only those that are asked for are decoded."""

    def __init__(self, letters: str, start: int, stop: int) -> None:
        self.letters, self.start, self.stop = letters, start, stop

    def __len__(self) -> int:
        return (self.stop - self.start) * 3 // 4

    def __getitem__(self, at: int | slice) -> int | bytes:
        first, last, _ = (at if isinstance(at, slice) else slice(at, at + 1)).indices(len(self))
        group = first // 3
        part = self.letters[self.start + 4 * group : min(self.stop, self.start + 4 * (-(-last // 3)))]
        found = base64.b64decode(part + "=" * (-len(part) % 4))[first - 3 * group : last - 3 * group]
        return found if isinstance(at, slice) else found[0]

    def startswith(self, what: bytes) -> bool:
        return self[: len(what)] == what


def der_tree(data: bytes | Decoded, at: int, end: int) -> list[tuple] | None:
    """The DER values that fill data[at:end], as (tag, start, end, children).

    Constructed values are followed to their leaves, and each must be filled by
    its children; object identifiers and integers must have a body. None if a
    length doesn't fit anywhere; nothing after that is looked at.
    """
    top: list[tuple] = []
    todo = [(at, end, top)]
    while todo:
        at, end, into = todo.pop()
        while at < end:
            value = _der(data, at, end)
            if not value:
                return None
            tag, start, at = value
            if tag == 0x02 and start == at or tag == 0x06 and (start == at or data[at - 1] & 0x80):
                return None
            children: list[tuple] = []
            into.append((tag, start, at, children))
            if tag & 0x20:
                todo.append((start, at, children))
    return top


def is_der_key(data: bytes | Decoded) -> bool:
    """A private key: a SEQUENCE that fills ``data``, whole down to its leaves, of one of four shapes.

    These are a version and integers (RSA, DSA), a version and an OCTET STRING
    (elliptic curves), a version, an algorithm and an OCTET STRING that holds a
    key's encoding (any algorithm), and an OCTET STRING encrypted with a
    password. Public keys and certificates have other shapes.
    """
    top = _der(data, 0, len(data))
    if not top or top[0] != 0x30 or len(data) - top[2] > 2 or top[2] - top[1] < 24:
        return False
    children = der_tree(data, top[1], top[2])
    if not children or len(children) < 2:
        return False
    (tag, start, end, inner), tags = children[0], [c[0] for c in children]
    algorithm = lambda c: c[0] == 0x30 and c[3] and c[3][0][0] == 0x06
    if tag == 0x02:
        if end - start != 1 or data[start] > 3:
            return False
        if tags[1] == 0x30:
            return algorithm(children[1]) and len(tags) > 2 and tags[2] == 0x04 and bool(der_tree(data, *children[2][1:3]))
        return tags[1] == 0x04 or tags[1:4] == [0x02] * 3 and set(tags[4:]) <= {0x02, 0x30}
    return bool(algorithm(children[0]) and tags[1:] == [0x04] and data[inner[0][1] : inner[0][2]].startswith(PASSWORD_BASED))


def _openssh_end(data: bytes | Decoded) -> int | None:
    """Where the container of private SSH keys ends: its magic, then four length-prefixed fields."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at = len(magic)
    for i in range(5):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if i == 3:  # the number of keys
            if n < 1:
                return None
            continue
        if at + n > len(data):
            return None
        at += n
    return at


def is_openssh_key(data: bytes | Decoded) -> bool:
    return _openssh_end(data) is not None


def is_signed_token(header: str, payload: str) -> bool:
    """Both parts decode to JSON objects, and the header names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
        body = json.loads(base64.urlsafe_b64decode(payload + "=" * (-len(payload) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _confirmed(data: bytes | Decoded) -> str | None:
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def _wrapped_keys(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Spans of the keys in a run of base64 lines without padding, from a line's start to a line's end.

    The outer length says how many letters a key has, so that it ends with the
    line in which these are reached, whatever the next line holds.
    """
    found, lines = [], [m.span() for m in _LINE.finditer(text, start, end) if m[1] is None]
    letters = "".join(text[a:b] for a, b in lines)
    ends = list(itertools.accumulate(b - a for a, b in lines))
    i = 0
    while i < len(lines):
        at = ends[i] - (lines[i][1] - lines[i][0])
        i += 1
        if letters[at] == "M":
            top = _der(base64.b64decode(letters[at : at + 8]), 0, 1 << 40) if at + 8 <= len(letters) else None
            size = top[2] if top and top[0] == 0x30 else None
        elif letters.startswith("b3BlbnNzaC1rZXktdjEA", at):
            # A last letter alone holds no byte.
            size = _openssh_end(Decoded(letters, at, len(letters) - ((len(letters) - at) % 4 == 1)))
        else:
            continue
        if size is None or -(-size * 4 // 3) > len(letters) - at:
            continue
        last = bisect.bisect_left(ends, at - (-size * 4 // 3))
        if (ends[last] - at) % 4 == 1:
            continue
        # Most lines that look like the start of a key aren't one, which shows in their first bytes.
        kind = _confirmed(Decoded(letters, at, ends[last]))
        if kind:
            stop = lines[last][1]
            while stop < len(text) and text[stop] == "=" and stop < lines[last][1] + 2:
                stop += 1
            found.append((lines[i - 1][0], stop, kind))
            i = last + 1
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the plain patterns, as (start, end, kind)."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of candidates whose decoded structure is that of a key or signed token."""
    found = []
    for m in _TOKEN.finditer(text) if "." in text else ():
        if is_signed_token(m[1], m[2]):
            found.append((m.start(), m.end(), "jwt"))
    for m in _BASE64.finditer(text):
        found += _wrapped_keys(text, *m.span(1))
    for m in _HEX_ANY.finditer(text):
        kind = _confirmed(bytes.fromhex(m[0]))
        if kind:
            found.append((m.start(), m.end(), kind))
    return found


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, by start and then by kind as in ``KINDS``."""
    if not text:
        return []
    found = base_spans(text) + structural_spans(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPAN_FIELDS = [("start", T.IntegerType(), pa.int32()), ("end", T.IntegerType(), pa.int32()), ("kind", T.StringType(), pa.string())]
SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in SPAN_FIELDS]))
ARROW_SPANS = pa.list_(pa.struct([(n, t) for n, _, t in SPAN_FIELDS]))


def scan_secrets(
    docs: DataFrame, text: str = "text", into: str = "secret_spans", redact: str | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the secret spans of every row's whole text.

    Input: any table with a string column ``text``. Output: all its columns and
    ``into``, an array of (start, end, kind) in code points, end exclusive. If
    the table has a column named ``into``, the new one gets underscores at its
    end. With ``redact``, that string also replaces each span in the text,
    overlapping spans being merged first. With ``keep``, only those columns of
    the input are returned.

    Null and empty texts have no spans and stay as they are. Repeated rows are
    scanned each for itself; an empty table gives an empty table; other columns
    may hold nulls and have any names. One pass without a shuffle; a task holds
    one Arrow batch of rows.
    """
    column = free_name(into, docs.columns)
    new = [(column, SPANS, ARROW_SPANS)]
    if redact is not None:
        new.append((text, docs.schema[text].dataType, pa.string()))

    def start():
        def make(texts: list) -> list[list]:
            spans = [find_spans(t) for t in texts]
            out = [[[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans]]
            if redact is not None:
                out.append([redacted(t, s, redact) if s else t for t, s in zip(texts, spans)])
            return out

        return make

    kept = list(docs.columns if keep is None else keep)
    return add_columns(docs, text, start, new, kept).select(*kept, column)


def redacted(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """``text`` with the merged spans replaced by ``mask``."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end = spans[i][:2]
        while i + 1 < len(spans) and spans[i + 1][0] <= end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], mask]
        at, i = end, i + 1
    return "".join([*out, text[at:]])
