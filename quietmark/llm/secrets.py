"""Secret scans: fixed shapes, and the token-efficiency test for the rest.

A byte-pair vocabulary spends few tokens on text of any language that it has
seen and many on random characters.  A candidate is a stretch of at least
``MIN_CHARS`` characters as keys and tokens have them (letters, digits, ``+ / _ -``,
up to two ``=`` at its end).  It is reported as ``random`` if it

* mixes letters with digits, or changes between upper and lower case at least
  ``CASE_CHANGES`` times (compound words and CamelCase names of prose do not);
* costs a token for every ``max_ratio`` characters or fewer;
* is no known digest (hexadecimal of a digest's length, or named by its algorithm),
  UUID or ULID, and more than digits with separators (dates, cards, numbers);
* shares no character with a span of a fixed shape, which is reported already.

Fixed shapes (matched left to right without overlap within a kind; a match that
is too short is dropped, but what it consumed stays consumed):

* ``assign``: a name of a secret, ``:`` or ``=``, and a value of six characters or
  more; the span is the whole match, ``value_start`` is where its value begins;
* ``access``: ``AKIA`` with capitals and digits, twenty or more in all;
* ``hex``: lower-case hexadecimal digits, twenty-four or more.

Offsets are code points, ends exclusive; spans are sorted by start, then by kind
in the order ``assign, access, hex, random``.  A null or empty text has no spans.
Texts are read whole, one row at a time; a candidate longer than ``STRETCH``
characters is encoded in stretches of that length and judged by the sum of their
tokens.  Repeated rows get equal spans; other columns pass through.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
# The shapes that every scan reports.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

MIN_CHARS = 16
MAX_RATIO = 2.0
CASE_CHANGES = 4
STRETCH = 4096
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CHARS)
_CASE_CHANGE = re.compile(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")
# Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_KNOWN = re.compile(
    "|".join(
        [
            *(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_CHARS),
            r"(?:md5|sha1|sha224|sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}",
            r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
            r"[0-7][0-9A-HJKMNP-TV-Z]{25}",
            r"[0-9+/_=-]+",
        ]
    )
)

SPANS = "array<struct<kind:string,start:bigint,end:bigint,value_start:bigint,ratio:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("ratio", pa.float64())])

_VOCABULARIES: dict[str, tiktoken.Encoding] = {}


def vocabulary(path: str) -> tiktoken.Encoding:
    """The vocabulary of a file of ranks, once a worker process and file."""
    if path not in _VOCABULARIES:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        units = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _VOCABULARIES[path] = tiktoken.Encoding("secrets", pat_str=units, mergeable_ranks=ranks, special_tokens={})
    return _VOCABULARIES[path]


def chars_per_token(text: str, encoding: tiktoken.Encoding) -> float:
    tokens = sum(len(encoding.encode_ordinary(text[at : at + STRETCH])) for at in range(0, len(text), STRETCH))
    return len(text) / tokens


def mixed(text: str) -> bool:
    """Whether a string mixes characters as random ones do and words do not."""
    letters = text.strip("0123456789+/_=-")
    if not letters:
        return False
    return any(c.isdigit() for c in text) or sum(1 for _ in _CASE_CHANGE.finditer(text)) >= CASE_CHANGES


def fixed_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, value start)`` of the fixed shapes, in order."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_spans(text: str, encoding: tiktoken.Encoding, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int, int, float | None]]:
    """``(kind, start, end, value start, characters a token)``; the ratio of random strings only."""
    spans = [(start, kind, end, value, None) for start, kind, end, value in fixed_spans(text)]
    taken, at, reach = [(s, e) for s, _, e, _, _ in spans], 0, 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        # Spans that begin before this candidate's end: the farthest of them tells whether one reaches into it.
        if reach > start or not mixed(own := m.group()) or _KNOWN.fullmatch(own):
            continue
        body = own.rstrip("=")
        ratio = chars_per_token(body, encoding)
        if ratio <= max_ratio:
            spans.append((start, 3, end, start, ratio))
    return [(KINDS[kind], start, end, value, ratio) for start, kind, end, value, ratio in sorted(spans, key=lambda s: s[:2])]


def _scan(path: str, max_ratio: float):
    def run(texts: pa.Array) -> pa.Array:
        encoding, names = vocabulary(path), [f.name for f in _SPAN]
        found = ([dict(zip(names, s)) for s in secret_spans(t.as_py() or "", encoding, max_ratio)] for t in texts)
        return pa.array(found, pa.list_(_SPAN))

    return run


def secrets(text: Column, ranks_path: str, max_ratio: float = MAX_RATIO) -> Column:
    """Spans of the secrets in a text; ``ranks_path`` is a vocabulary of byte-pair ranks that every worker can read."""
    return F.arrow_udf(_scan(ranks_path, max_ratio), SPANS)(text)
