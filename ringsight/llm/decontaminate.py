"""Benchmark decontamination: a BM25 index of the test items, asked with every training passage.

Passages are word windows at least twice as long as any item, stepping by half, so that a copied
item lies whole in one of them. The index holds impacts divided by each item's threshold (a
share of the score an item gives itself), so a pair counts from a sum of 1. Items stand in
blocks with the largest impact of every term. A passage whose sum of block maxima stays under 1
has no match in that block; the others are searched by block-max WAND, which skips items and
blocks that can't reach 1. All items above the threshold are returned and then verified: question and
answer must both be in the passage, by their word n-grams or, where changed words have broken too many
of these, as a run of words with few edits. The threshold lets any one word be changed. Texts and items are compared without case
in all scripts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ringsight.llm.common import free_name
from ringsight.llm.wordhash import ODD, SYMBOLS, Words, mix, slices

K1, B = 1.2, 0.75
SHARE = 0.5  # of an item's score with itself that a passage must reach
OVERLAP = 0.6  # of the n-grams of question and of answer that must be in the passage
ALIGNED = 0.75  # or 1 - edits / words of the best aligned run; one changed word in four to seven
NGRAM = 3
LEAST = 5  # words of a question or an answer
BLOCK = 4  # items to a block of the index
PART_ITEMS = 512  # items to a part of the index; block maxima are held per word of a slice
PASS_PARTS = 16  # parts sent to the executors at once and searched in one pass over the texts


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    lists: list[tuple[np.ndarray, np.ndarray]]  # items and impacts of each term
    most: np.ndarray  # the largest impact of each term
    block_most: np.ndarray  # and by block; a row of zeros at the end for other words
    window: int  # words in half a passage
    ids: list[int | None]
    share: np.ndarray  # of its score with itself that finds an item
    question: list[tuple[int, np.ndarray, np.ndarray]]  # n, the hashed n-grams, the words
    answer: list[tuple[int, np.ndarray, np.ndarray]]


def _folded(text: Column) -> Column:
    """Without case in any script; ß and ς, which capitals don't keep apart, count as ss and σ."""
    return F.replace(F.replace(F.lower(text.cast("string")), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def split_item(words: int, sentence_ends: list[int]) -> int:
    """Words of the question: all sentences but the last few, so that both parts have LEAST words; three
    quarters where no sentence ends so. An item of fewer than 2 * LEAST words is not split (0)."""
    if words < 2 * LEAST:
        return 0
    inner = [e for e in sentence_ends if LEAST <= e <= words - LEAST]
    return inner[-1] if inner else min(words * 3 // 4, words - LEAST)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct word n-grams."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * ODD[j]
    return np.unique(mix(out + np.uint64(n)))


def _part(h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the n-grams and the words of a question or an answer; n is NGRAM, or less for fewer words."""
    n = max(1, min(NGRAM, len(h)))
    return n, _grams(h, n), h


def fewest_edits(part: list[int], passage: list[int]) -> int:
    """Words to change, drop or add so that ``part`` is a run of words of ``passage`` (Myers' bit vectors)."""
    if not part:
        return 0
    full, top = (1 << len(part)) - 1, 1 << (len(part) - 1)
    at: dict[int, int] = {}
    for i, word in enumerate(part):
        at[word] = at.get(word, 0) | 1 << i
    up, down, edits = full, 0, len(part)
    fewest = edits
    for word in passage:
        same = at.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        edits += (more & top > 0) - (less & top > 0)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(same | down | more)), more & (same | down)
        fewest = min(fewest, edits)
    return fewest


def _overlap(part: tuple[int, np.ndarray, np.ndarray], passage: np.ndarray) -> float:
    """Share of the n-grams in the passage, or of the words of the best aligned run where only that is enough."""
    n, grams, words = part
    share = float(np.isin(grams, _grams(passage, n)).mean())
    if share < OVERLAP and np.isin(words, passage).mean() >= ALIGNED:
        aligned = 1 - fewest_edits(words.tolist(), passage.tolist()) / len(words)
        if aligned >= ALIGNED:
            return aligned
    return share


def build(rows: list[tuple[int | None, str]], df: dict[int, int], items: int, mean: float) -> Index:
    """``df``, ``items`` and ``mean`` are the statistics of all items, also of other parts."""
    words = Words(pa.array([t for _, t in rows], pa.large_string()), blank=SYMBOLS)
    h = words.hashes
    ids, question, answer, each, share = [], [], [], [], np.full(len(rows), SHARE)
    for r, (item, _) in enumerate(rows):
        lo, hi = words.rows[r], words.rows[r + 1]
        own = h[lo:hi]
        after = [words.bytes[words.ends[i] : words.starts[i + 1]] for i in range(lo, hi - 1)]
        ends = [i + 1 for i, gap in enumerate(after) if np.isin(gap, (46, 33, 63, 10)).any()]
        cut = split_item(len(own), ends)
        ids.append(item)
        question.append(_part(own[:cut] if cut else own))
        answer.append(_part(own[cut:]))
        each.append(np.unique(own, return_counts=True))
    postings: dict[int, list[tuple[int, float]]] = {}
    for i, (term, tf) in enumerate(each):
        if not len(term):
            continue
        n = np.array([df[int(t)] for t in term], float)
        idf = np.log(1 + (items - n + 0.5) / (n + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean))
        if tf.sum() * (1 - ALIGNED) >= 1 and len(term) > 1:
            # What stays without the heaviest word.
            share[i] = min(SHARE, (1 - impact.max() / impact.sum()) * (1 - 1e-6))
        for t, x in zip(term.tolist(), impact / (share[i] * impact.sum())):
            postings.setdefault(t, []).append((i, x))
    terms = np.array(sorted(postings), np.uint64)
    lists = [(np.array([i for i, _ in postings[t]]), np.array([x for _, x in postings[t]])) for t in terms.tolist()]
    block_most = np.zeros((len(terms) + 1, -(-len(rows) // BLOCK)), np.float32)
    for k, (at, x) in enumerate(lists):
        np.maximum.at(block_most[k], at // BLOCK, x.astype(np.float32))
    longest = max([1, *np.diff(words.rows).tolist()])
    most = np.array([x.max() for _, x in lists])
    return Index(terms, lists, most, block_most * np.float32(1.0001), longest, ids, share, question, answer)


def search(index: Index, terms: list[int]) -> list[tuple[int, float]]:
    """Every item with an impact sum of at least 1 over ``terms``, by block-max WAND."""
    end = 1 << 60
    lists = [index.lists[t] for t in terms]
    at = [0] * len(terms)
    now = [int(x[0][0]) for x in lists]
    found = []

    def advance(k: int, to: int) -> None:
        at[k] = int(np.searchsorted(lists[k][0], to))
        now[k] = int(lists[k][0][at[k]]) if at[k] < len(lists[k][0]) else end

    while True:
        order = sorted(range(len(terms)), key=now.__getitem__)
        total, pivot = 0.0, None
        for place, k in enumerate(order):
            if now[k] == end:
                break
            total += index.most[terms[k]]
            if total >= 0.9999:
                pivot = place
                break
        if pivot is None:
            return found
        item = now[order[pivot]]
        while pivot + 1 < len(order) and now[order[pivot + 1]] == item:
            pivot += 1
        ahead = order[: pivot + 1]
        block = item // BLOCK
        if sum(float(index.block_most[terms[k], block]) for k in ahead) < 1:
            # No item of this block up to the next list's item can reach 1.
            later = now[order[pivot + 1]] if pivot + 1 < len(order) else end
            to = min((block + 1) * BLOCK, later)
            for k in ahead:
                if now[k] < to:
                    advance(k, to)
        elif now[order[0]] == item:
            score = sum(float(lists[k][1][at[k]]) for k in ahead)
            if score >= 0.9999:
                found.append((item, score))
            for k in ahead:
                advance(k, item + 1)
        else:
            for k in ahead:
                if now[k] < item:
                    advance(k, item)


def _reach(index: Index, at: np.ndarray, begin: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Per passage, two halves long, a bound of the impact sum in each block; ``at`` are the words' places in the index."""
    # Each word of the index once per half: other words add nothing, and repeats would only loosen the bound.
    known = np.flatnonzero(at < len(index.terms))
    inside = np.searchsorted(begin, known, "right") - 1
    inside, term = np.divmod(np.unique(inside * len(index.terms) + at[known]), len(index.terms))
    half = np.zeros((len(begin), index.block_most.shape[1]), np.float32)
    if len(inside):
        edge = np.flatnonzero(np.diff(inside, prepend=-1))
        half[inside[edge]] = np.add.reduceat(index.block_most[term], edge, axis=0)
    reach = half.copy()
    together = np.flatnonzero(row_of[1:] == row_of[:-1])
    reach[together] += half[together + 1]
    return reach


def _matches(index: Index, words: Words) -> list[list[tuple[int, float, float, float]]]:
    """Per row: item, score as a share of the item's own, question and answer overlap; best passage each."""
    out: list[list] = [[] for _ in range(len(words.rows) - 1)]
    h = words.hashes
    if not len(h) or not len(index.terms):
        return out
    at = np.searchsorted(index.terms, h)
    at[at == len(index.terms)] = 0
    at = np.where(index.terms[at] == h, at, len(index.terms))
    counts = np.diff(words.rows)
    halves = -(-counts // index.window)
    row_of = np.repeat(np.arange(len(counts)), halves)
    first = np.concatenate([[0], np.cumsum(halves)])
    begin = words.rows[row_of] + (np.arange(len(row_of)) - first[row_of]) * index.window
    reach = _reach(index, at, begin, row_of)
    for p in np.flatnonzero(reach.max(axis=1) >= 1):
        row = row_of[p]
        lo, hi = begin[p], min(begin[p] + 2 * index.window, words.rows[row + 1])
        terms = np.unique(at[lo:hi])
        terms = terms[terms < len(index.terms)]
        if index.block_most[terms].sum(axis=0).max(initial=0) < 1:
            continue
        hits = search(index, terms.tolist())
        for item, score in hits:
            shares = [_overlap(part, h[lo:hi]) for part in (index.question[item], index.answer[item])]
            if min(shares) >= OVERLAP:
                out[row].append((item, round(score * float(index.share[item]), 9), *shares))
    for r, hits in enumerate(out):
        best: dict[int, tuple] = {}
        for hit in hits:
            if hit[0] not in best or hit[1:] > best[hit[0]][1:]:
                best[hit[0]] = hit
        out[r] = [best[i] for i in sorted(best)]
    return out


def _parts(benchmark: DataFrame):
    """Indexes of all items, PART_ITEMS at a time; document frequencies are those of all items."""
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(_folded(F.col("text")), F.lit("")).alias("text"))

    def count(batches):
        for part in slices(batches):
            words = Words(part.column("text"), blank=SYMBOLS)
            row = np.repeat(np.arange(part.num_rows), np.diff(words.rows))
            pairs = np.unique(np.stack([row.astype(np.uint64), words.hashes]), axis=1)[1]
            yield pa.record_batch([pa.array(pairs.view(np.int64)), pa.array(np.ones(len(pairs), np.int64)), pa.array(np.zeros(len(pairs), np.int64))], names=["h", "df", "words"])
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([part.num_rows], pa.int64()), pa.array([len(row)], pa.int64())], names=["h", "df", "words"])

    # One row for each distinct word of the benchmark, and one without a word for the totals.
    stats = rows.mapInArrow(count, "h bigint, df bigint, words bigint").groupBy("h").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    items = rows.count()
    parts = max(1, -(-items // PART_ITEMS))
    if not items:
        return
    found = stats.collect()  # the vocabulary of the test items, a stated set
    df = {int(np.int64(r.h).view(np.uint64)): r.df for r in found if r.h is not None}
    mean = max(1.0, sum(r.words for r in found if r.h is None) / items)
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield build([(r.item_id, r.text) for r in own], df, items, mean)


def _passes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """The parts of the index, PASS_PARTS at a time, as broadcasts of plain arrays: a class would have to be installed."""
    for some in batched(_parts(benchmark), PASS_PARTS):
        yield docs.sparkSession.sparkContext.broadcast([tuple(getattr(index, name) for name in Index.__match_args__) for index in some])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, bm25_share, question_overlap, answer_overlap)`` for every copied item of every row.

    An overlap is the share of the word n-grams found, or, where that is under OVERLAP, 1 - edits / words
    of the best aligned run. An item of fewer than four words is found by whole n-grams only.
    Null or empty texts match nothing, on either side; an item without words is never found.
    Repeated rows of ``docs`` and repeated items give repeated pairs; null ids are carried as
    they are. Other columns are ignored. The texts are read once for every PASS_PARTS * PART_ITEMS items.
    """
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), _folded(docs["text"]).alias("text"))
    schema = "doc_id bigint, item_id bigint, bm25_share double, question_overlap double, answer_overlap double"
    out: DataFrame | None = None
    for held in _passes(docs, benchmark):

        def each(batches, held=held):
            indexes = [Index(*parts) for parts in held.value]
            for part in slices(batches):
                words = Words(part.column("text"), blank=SYMBOLS)
                flat = [(r, index.ids[hit[0]], hit) for index in indexes for r, hits in enumerate(_matches(index, words)) for hit in hits]
                cols = [part.column("doc_id").take(pa.array([r for r, _, _ in flat], pa.int64()))]
                cols.append(pa.array([item for _, item, _ in flat], pa.int64()))
                cols += [pa.array([hit[k] for _, _, hit in flat], pa.float64()) for k in (1, 2, 3)]
                yield pa.record_batch(cols, names=["doc_id", "item_id", "bm25_share", "question_overlap", "answer_overlap"])

        found = docs.mapInArrow(each, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no copied item, all columns kept."""
    out = docs
    for held in _passes(docs, benchmark):
        text = free_name(docs, "_text")

        def each(batches, held=held, text=text):
            indexes = [Index(*parts) for parts in held.value]
            for part in slices(batches, text):
                words, clean = Words(part.column(text), blank=SYMBOLS), np.ones(part.num_rows, bool)
                for index in indexes:
                    clean &= [not hits for hits in _matches(index, words)]
                yield part.filter(pa.array(clean)).remove_column(part.schema.get_field_index(text))

        out = out.withColumn(text, _folded(F.col("text"))).mapInArrow(each, docs.schema)
    return out
