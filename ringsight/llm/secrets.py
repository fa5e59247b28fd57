"""Secret scan: fixed patterns, and strings that a tokenizer's vocabulary can't shorten.

Natural text and names fill several characters per token, random strings two or fewer. Long
runs of letters, digits and key characters with a low ratio are reported, after known digests,
UUIDs, numbers and identifiers made of words are excluded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "random")
LEAST = 20  # characters of a candidate
RATIO = 2.2  # characters per token, at most, of a random string

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
WORDS = ("passw", "secret", "token", "api")  # a text without one of these has no assignment
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 characters or more
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
DIGIT = re.compile("[0-9]")
DIGESTS = {32, 40, 56, 64, 96, 128}  # hex digits of MD5, SHA-1 and the SHA-2 family
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
# Words of letters with at most a short number each, joined by dashes, slashes or underscores, or in camel case.
NAME = re.compile(  # possessive: never tried another way, so long strings cost one pass
    r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)(?:[-_/+=]*+[0-9]{0,4}+[-_/+=]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+))*+[-_/=]*+[0-9]{0,4}+[-_/=]*+"
)


class _Encodings:
    """One encoding for a process and a file; sent to the executors empty."""

    def __init__(self) -> None:
        self.held: dict = {}

    def __reduce__(self):
        return _Encodings, ()

    def get(self, path: str, pattern: str):
        if path not in self.held:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.held[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return self.held[path]


_ENCODINGS = _Encodings()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def excluded(s: str) -> bool:
    """Known digests and identifiers: hex of a digest's length, UUIDs, numbers, words and names made of words."""
    bare = s.strip("+/_=-")
    if not DIGIT.search(bare) or bare.isdigit() or UUID.fullmatch(bare):
        return True
    if len(bare) in DIGESTS and all(c in "0123456789abcdefABCDEF" for c in bare):
        return True
    return NAME.fullmatch(bare) is not None


def random_spans(text: str, base: list[tuple[int, int, int]], encoding) -> list[tuple[int, int, int, float]]:
    """``(start, kind, end, ratio)`` of the token-inefficient strings that no base span touches."""
    if not DIGIT.search(text):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if excluded(s) or any(b < m.end() and m.start() < e for b, _, e in base):
            continue
        ratio = len(s) / len(encoding.encode_ordinary(s))
        if ratio <= RATIO:
            out.append((m.start(), 3, m.end(), ratio))
    return out


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts by kind, digest of the base spans, all spans, lowest ratio.

    A null text counts as empty; an empty one has no spans, the digest of the empty string and a
    null ratio. Repeated rows give equal rows; a null doc_id is carried through. Other columns
    are ignored. ``path`` names a tiktoken rank file, ``pattern`` its pre-token expression.
    """
    given = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    fields = [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("least_ratio", pa.float64())]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _ENCODINGS.get(path, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base, encoding)
                spans = sorted([*base, *[x[:3] for x in more]])
                n = [sum(1 for x in spans if x[1] == k) for k in range(len(KINDS))]
                rows.append((doc, *n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), min((x[3] for x in more), default=None)))
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, least_ratio double"
    return given.mapInArrow(each, schema)
