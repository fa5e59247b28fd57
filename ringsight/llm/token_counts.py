"""Exact token counts of whole texts without token ids.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum over its
pre-tokens of the count of each. Three steps: the distinct pre-tokens of all texts with their
frequency; the number of pieces of each, once; and the sum over every document's pre-token
frequencies. The most frequent pre-tokens (a fixed number of short strings) are sent to the
executors, the others are joined, so no join key is hot.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ringsight.llm.common import stored
from ringsight.llm.wordhash import slices

HEAD, HEAD_CHARS = 131_072, 64  # pre-tokens sent to the executors: number and length at most
FLUSH = 200_000  # distinct pre-tokens held by a task before it passes their counts on
OUT = 20_000  # rows of a batch of these counts
LIMIT = 1024

# The pre-token expression of byte-level BPE with the letter, number and space
# classes written out for code points below U+0250. Other texts are cut by the tokenizer itself.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
PLAIN = f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Cutter:
    """Cuts texts into pre-tokens and counts the pieces of pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        kind = config["pre_tokenizer"] or {}
        if config["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
            raise ValueError("only byte-level tokenizers without normalizer and prefix space are counted this way")
        added = config["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take spaces are not counted this way")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.plain, self.other = re.compile(PLAIN), re.compile("[^\x00-ɏ]")
        self.letters = _byte_letters()

    def _cut(self, text: str) -> list[str]:
        if not self.other.search(text):
            return self.plain.findall(text)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self.letters[c] for c in piece).decode() for piece, _ in pieces]

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of added tokens whose strings stand in the text."""
        if self.added is None or not self.added.search(text):
            return self._cut(text), 0
        parts = self.added.split(text)
        return [p for part in parts for p in self._cut(part)], len(parts) - 1

    def sizes(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]


class _Cutters:
    """One cutter for a process and a file; sent to the executors empty."""

    def __init__(self) -> None:
        self.held: dict[str, Cutter] = {}

    def __reduce__(self):
        return _Cutters, ()

    def get(self, path: str) -> Cutter:
        if path not in self.held:
            self.held[path] = Cutter(path)
        return self.held[path]


_CUTTERS = _Cutters()


def pretoken_sizes(texts: DataFrame, path: str) -> DataFrame:
    """``(pretoken, n, pieces)``: each distinct pre-token of ``texts(text)``, how often it stands there, its pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = _CUTTERS.get(path), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = iter(seen.items())
            while part := list(islice(items, OUT)):
                yield pa.record_batch({"pretoken": pa.array([t for t, _ in part], pa.string()), "n": pa.array([n for _, n in part], pa.int64())})

        for batch in slices(batches):
            for text in batch.column("text"):
                seen.update(cutter.cut(text.as_py())[0])
                if len(seen) > FLUSH:
                    yield from out()
                    seen = Counter()
        yield from out()

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _CUTTERS.get(path)
        for batch in batches:
            yield batch.append_column("pieces", pa.array(cutter.sizes(batch.column("pretoken").to_pylist()), pa.int64()))

    each = texts.mapInArrow(count, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return each.mapInArrow(size, "pretoken string, n bigint, pieces bigint")


def _head(sizes: DataFrame) -> DataFrame:
    """Pre-tokens frequent enough that at most HEAD are."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 8)
    per = sizes.where(F.length("pretoken") <= HEAD_CHARS).groupBy(grade.alias("g")).count().orderBy(F.desc("g")).collect()
    total, least = 0, None
    for row in per:  # a few hundred grades at most
        total += row["count"]
        if total > HEAD:
            break
        least = row.g
    if least is None:
        return sizes.limit(0)
    return sizes.where((F.length("pretoken") <= HEAD_CHARS) & (grade >= least))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit, n_pretokens``.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each for itself;
    a null doc_id is carried through. Strings of added tokens inside a text count as that one
    token, as the library reads them. Other columns are ignored.
    """
    given = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sizes = stored(pretoken_sizes(given.select("text"), path))
    head = {r.pretoken: r.pieces for r in _head(sizes).collect()}  # HEAD rows at most
    shared = given.sparkSession.sparkContext.broadcast(head)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = _CUTTERS.get(path), shared.value
        for batch in slices(batches):
            rows, rest, counts, edges = [], [], [], [0]
            for text in batch.column("text"):
                text = text.as_py()
                pretokens, total = cutter.cut(text)
                for pretoken, n in Counter(pretokens).items():
                    pieces = known.get(pretoken)
                    if pieces is None:
                        rest.append(pretoken)
                        counts.append(n)
                    else:
                        total += n * pieces
                edges.append(len(rest))
                # The row's own name: repeated ids stay apart.
                rows.append((uuid.uuid4().bytes, len(text.encode()), len(pretokens), total))
            row, n_bytes, n_pretokens, total = (pa.array(c, k) for c, k in zip(zip(*rows), kinds))
            tail = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(counts, pa.int64())], ["pretoken", "n"])
            tail = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), tail)
            yield pa.record_batch(
                [row, batch.column("doc_id"), n_bytes, n_pretokens, total, tail], names=["row", "doc_id", "n_bytes", "n_pretokens", "known", "rest"]
            )

    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    counted = stored(given.mapInArrow(
        each, "row binary, doc_id bigint, n_bytes bigint, n_pretokens bigint, known bigint, rest array<struct<pretoken:string,n:bigint>>"
    ))
    tail = (
        counted.select("row", F.explode("rest").alias("r")).select("row", "r.pretoken", "r.n")
        .join(sizes.select("pretoken", "pieces"), "pretoken")
        .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    )
    n = F.col("known") + F.coalesce("more", F.lit(0))
    return counted.select("row", "doc_id", "n_bytes", "n_pretokens", "known").join(tail, "row", "left").select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), "n_pretokens"
    )
