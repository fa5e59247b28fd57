"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for its ends) and itself, hashed to
buckets that hold embeddings; a passage of a few words is the mean of its subwords' embeddings,
and a linear softmax on top gives its class. Embeddings and softmax are trained together, so an
unseen spelling shares most of its n-grams' vectors. Labels are given for whole documents: after
the first epochs only the passages of a toxic document that stand out keep its label. A
document's score is its most toxic passage, made a probability on held-back training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ringsight.llm.wordhash import SYMBOLS, Words, mix, slices

CLASS_DOCS = 4_000  # labelled rows of each class in the training sample, at most
SAMPLE_BYTES = 20 << 20  # of their texts together
BUCKET_BITS, DIM = 18, 8
SIZES = (3, 4, 5)
PASSAGE = 2  # words
EPOCHS = (2, 3)  # with the document's label for all its passages, and with chosen ones
BATCH, LEAST_BATCH, RATE = 4096, 64, 0.25
UPDATES = 1000  # at least, over all epochs: small sets get small batches, and then more epochs
FOLDS, HELD_FOLD = 4, 2
CALIBRATION = 5  # every fifth training document only sets the probabilities
THRESHOLD = 0.3
SEED = 43


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _grams(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte positions and buckets of all subwords: n-grams inside words, then whole words."""
    size = len(words.bytes)
    word = np.full(size, -1, np.int64)
    for_each = words.ends - words.starts
    word[np.repeat(words.starts, for_each) + _ramp(for_each)] = np.repeat(np.arange(len(words.starts)), for_each)
    begins, closes = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    begins[words.starts], closes[words.ends] = True, True
    for n in SIZES:
        if size < n:
            continue
        at = np.flatnonzero((word[: size - n + 1] >= 0) & (word[: size - n + 1] == word[n - 1 :]))
        h = words.span_hash(at, at + n)
        h = mix(h + begins[at] * np.uint64(0xA24BAED4963EE407) + closes[at + n] * np.uint64(0x9FB21C651E98DF25))
        yield at, _slots(h)
    yield words.starts, _slots(mix(words.hashes + np.uint64(7)))


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, and the row it is in."""
    counts = np.diff(words.rows)
    per = -(-counts // PASSAGE)
    row = np.repeat(np.arange(len(counts)), per)
    return words.rows[row] + _ramp(per) * PASSAGE, row


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: its embedding times the difference of the softmax columns
    bias: float
    slope: float  # of the logistic curve from a document's largest passage score
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts, blank=SYMBOLS)
        return self.probability(_row_max(self.raw(words), _passages(words)[1], len(texts)))

    def raw(self, words: Words) -> np.ndarray:
        """Score of each passage."""
        first, _ = _passages(words)
        edges = words.starts[first] if len(first) else np.empty(0, np.int64)
        total, n = np.zeros(len(first)), np.zeros(len(first))
        for at, slot in _grams(words):
            if not len(first):
                break
            place = np.searchsorted(edges, at, "right") - 1
            total += np.bincount(place, self.weight[slot], len(first))
            n += np.bincount(place, minlength=len(first))
        return total / np.maximum(n, 1) + self.bias

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.offset, -30, 30)))


def _row_max(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The largest value of each row; of a row without passages a value below all others."""
    out = np.full(rows, -30.0)
    np.maximum.at(out, row, values)
    return out


def _corpus(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all passages one after another, the range of each passage, and its text."""
    slots, counts, docs, done = [], [], [], 0
    for part in slices(iter([pa.record_batch({"text": pa.array(texts, pa.string())})]) if texts else iter([])):
        words = Words(part.column("text"), blank=SYMBOLS)
        first, row = _passages(words)
        if len(first):
            edges = words.starts[first]
            pieces = list(_grams(words))
            place = np.concatenate([np.searchsorted(edges, at, "right") - 1 for at, _ in pieces])
            order = np.argsort(place, kind="stable")
            slots.append(np.concatenate([s for _, s in pieces])[order].astype(np.int32))
            counts.append(np.bincount(place, minlength=len(first)))
            docs.append(row + done)
        done += part.num_rows
    if not slots:
        return np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)
    return np.concatenate(slots), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(docs)


def train(texts: list[str], labels: np.ndarray, prior: float) -> Model:
    """Fit on whole texts; ``prior`` is the share of toxic rows among all labelled ones."""
    slots, edges, doc = _corpus(texts)
    if not len(doc) or labels.min() == labels.max():
        level = float(np.clip(prior, 1e-3, 1 - 1e-3))
        return Model(np.zeros(1 << BUCKET_BITS), 0.0, 0.0, float(np.log(level / (1 - level))))
    rng = np.random.default_rng(SEED)
    fitted = np.arange(len(texts)) % CALIBRATION != 0
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    soft = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e, seen_w, seen_b = np.full(1 << BUCKET_BITS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    target = labels[doc].astype(np.int64)

    def epoch(chosen: np.ndarray) -> None:
        nonlocal soft, bias
        for batch in np.array_split(rng.permutation(chosen), max(1, len(chosen) // size)):
            n = (edges[batch + 1] - edges[batch]).astype(np.int64)
            flat = slots[np.repeat(edges[batch], n) + _ramp(n)]
            start = np.cumsum(n) - n
            mean = np.add.reduceat(emb[flat], start, axis=0) / n[:, None].astype(np.float32)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), target[batch]] -= 1
            back = (p @ soft.T) / n[:, None].astype(np.float32)
            order = np.argsort(flat, kind="stable")
            sorted_slots = flat[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_slots[1:] != sorted_slots[:-1]]))
            grad = np.add.reduceat(back[np.repeat(np.arange(len(batch)), n)[order]], first, axis=0)
            hit = sorted_slots[first]
            seen_e[hit] += (grad * grad).mean(axis=1)
            emb[hit] -= RATE * grad / np.sqrt(seen_e[hit])[:, None]
            for value, g, seen in ((soft, mean.T @ p / len(batch), seen_w), (bias, p.mean(axis=0), seen_b)):
                seen += g * g
                value -= RATE * g / np.sqrt(seen)

    def line() -> tuple[np.ndarray, float]:
        return (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0])

    def passage_scores() -> np.ndarray:
        weight, b = line()
        out = np.empty(len(doc))
        for lo in range(0, len(doc), 1 << 16):  # in parts, to hold few numbers at once
            cut = edges[lo : lo + (1 << 16) + 1]
            out[lo : lo + (1 << 16)] = np.add.reduceat(weight[slots[cut[0] : cut[-1]]], cut[:-1] - cut[0]) / np.diff(cut) + b
        return out

    use = np.flatnonzero(fitted[doc])
    size = int(np.clip(sum(EPOCHS) * len(use) // UPDATES, LEAST_BATCH, BATCH))
    more = -(-UPDATES // (sum(EPOCHS) * max(1, len(use) // size)))
    for _ in range(EPOCHS[0] * more):
        epoch(use)
    for _ in range(EPOCHS[1] * more):
        # A toxic document's passage keeps the label if it stands out from those of clean ones, or from its own document.
        score = passage_scores()
        usual = np.quantile(score[use[labels[doc[use]] == 0]], 0.999)
        top = _row_max(score, doc, len(texts))
        target = ((labels[doc] == 1) & ((score >= usual) | (score >= top[doc]))).astype(np.int64)
        epoch(use)
    top = _row_max(passage_scores(), doc, len(texts))
    check = ~fitted if len(set(labels[~fitted])) == 2 else np.ones(len(texts), bool)
    slope, offset = _logistic(top[check], labels[check], prior)
    weight, b = line()
    return Model(weight, b, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve, the classes weighted to their share among all labelled rows."""
    w = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    scale = x.std() or 1.0
    m, z = x.mean(), (x - x.mean()) / scale
    a = c = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        g = np.array([(w * (p - y) * z).sum() + a * 0.1, (w * (p - y)).sum()])
        v = w * p * (1 - p) + 1e-9
        hess = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum()]])
        step = np.linalg.solve(hess, g)
        a, c = a - step[0], c - step[1]
    return max(a, 0.0) / scale, c - max(a, 0.0) * m / scale


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of a bounded sample of labelled rows outside the held-out fold, and the share of toxic ones."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold_of(F.col("doc_id")) != HELD_FOLD).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    rank = F.xxhash64(F.lit(SEED), "doc_id")
    picked = known.where("toxic = 1").orderBy(rank, "doc_id").limit(CLASS_DOCS).union(known.where("toxic = 0").orderBy(rank, "doc_id").limit(CLASS_DOCS))
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    sized = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.octet_length("text").alias("size")).groupBy("doc_id", "toxic").agg(
        F.max("size").alias("size")
    ).orderBy(rank, "doc_id").collect()  # 2 * CLASS_DOCS rows at most
    # In the order of the hash up to the budget, so that long texts are left out no more often than short
    # ones; only a text longer than the whole budget is passed over.
    total, ids = 0, []
    for r in sized:
        if r.size > SAMPLE_BYTES:
            continue
        total += r.size
        if total > SAMPLE_BYTES:
            break
        ids.append((r.doc_id, r.toxic))
    if not ids:
        return [], np.empty(0, np.int64), prior
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id bigint, toxic int")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], np.array([r.toxic for r in rows], np.int64), prior


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Labels are learned only from rows outside the held-out fold (crc32 of the id's text modulo
    FOLDS). A null or empty text has no passage and gets the lowest score. A null doc_id is in no
    fold and not held out. Repeated rows give equal rows. Without labels of both classes every
    score is the share of toxic labels. Other columns are ignored.
    """
    fitted = train(*training_sample(docs, labels))
    # Plain numbers: a class would have to be installed on the executors.
    sent = docs.sparkSession.sparkContext.broadcast((fitted.weight, fitted.bias, fitted.slope, fitted.offset))
    given = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for part in slices(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array(model.scores(part.column("text")))], names=["doc_id", "score"])

    held = F.coalesce(fold_of(F.col("doc_id")) == HELD_FOLD, F.lit(False))
    return given.mapInArrow(each, "doc_id bigint, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
