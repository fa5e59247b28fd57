"""Quality classifier by importance resampling with hashed n-gram models.

Two bag-of-features models over the same buckets (hashed words and word pairs): one of the
target (documents labelled good), one of all raw documents. A document's log weight is the sum
of log(target / raw) over its features. Gumbel noise is added and the k largest sums are kept,
which draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ringsight.functions.ordered import with_position
from ringsight.llm.common import columns_of, free_name, stored
from ringsight.llm.wordhash import ODD, Words, mix, slices

BUCKETS = 1 << 18
TARGET_DOCS = 20_000  # labelled rows of each class used, at most; raw counts cover all documents
PSEUDO = 2.0  # added to the count of every bucket in both models
REJECT_COST = 3.0  # of rejecting a good document, against keeping a bad one
SEED = 20


@dataclass
class Model:
    log_ratio: np.ndarray  # of each bucket
    cut: float  # log weight that parts the labelled classes best


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a slice, and the row of each."""
    h = words.hashes
    row = np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))
    pair = mix(h[:-1] * ODD[0] + h[1:] * ODD[1])[row[1:] == row[:-1]]
    pair_row = row[1:][row[1:] == row[:-1]]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([h, pair]) >> shift).astype(np.int64), np.concatenate([row, pair_row])


def _drawn_labels(labels: DataFrame) -> DataFrame:
    """At most TARGET_DOCS ids of each class, the first by a hash of the id."""
    known = labels.where("doc_id is not null and quality is not null").select(
        "doc_id", (F.col("quality") == 1).cast("int").alias("_good")
    ).groupBy("doc_id").agg(F.min("_good").alias("_good"))
    ranked = F.xxhash64(F.lit(SEED), "doc_id")
    parts = [known.where(F.col("_good") == v).orderBy(ranked, "doc_id").limit(TARGET_DOCS) for v in (0, 1)]
    return parts[0].union(parts[1])


def _weights(model_ratio: np.ndarray, words: Words) -> np.ndarray:
    bucket, row = _features(words)
    return np.bincount(row, model_ratio[bucket], len(words.rows) - 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Count both models in one pass over all documents; set the cut on the drawn labelled rows."""
    spark = docs.sparkSession
    drawn = stored(_drawn_labels(labels))  # at most 2 * TARGET_DOCS rows of two numbers
    marked = columns_of(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id", "left")
    # Half of the drawn rows fit the target, the others set the cut: their weights are like those of unlabelled rows.
    half = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2))
    marked = marked.withColumn("_fits", F.when((F.col("_good") == 1) & (half == 0), 1)).withColumn("_cuts", F.when(half == 1, F.col("_good")))

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            bucket, row = _features(Words(part.column("text")))
            good = part.column("_fits").fill_null(0).to_numpy(zero_copy_only=False) == 1
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["b", "raw", "target"])

    counts = (
        marked.select("text", "_fits").mapInArrow(count, "b bigint, raw bigint, target bigint")
        .groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["b"]], target[counts["b"]] = counts["raw"], counts["target"]
    # The raw counts are brought to the size of the target, so that a bucket too rare to tell says nothing.
    scale = target.sum() / max(raw.sum(), 1.0)
    ratio = np.log(target + PSEUDO) - np.log(raw * scale + PSEUDO)
    model = Model(ratio, -np.inf)
    scored = weigh(marked.where("_cuts is not null"), model, "_w").select("_w", "_cuts").where("_w is not null").toPandas()
    good, bad = (np.sort(scored["_w"][scored["_cuts"] == v].to_numpy()) for v in (1, 0))
    if len(good) and len(bad):
        # The cut with the least cost of errors, as shares of each class; in the middle of its gap.
        at = np.unique(np.concatenate([good, bad]))
        edges = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
        loss = REJECT_COST * np.searchsorted(good, edges) / len(good) + 1 - np.searchsorted(bad, edges) / len(bad)
        best = np.flatnonzero(loss <= loss.min() + 1e-12)
        gap = np.diff(np.concatenate([[at[0] - 2], at]))[best]
        model.cut = float(edges[best[np.argmax(gap)]])
    return model


def weigh(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the log weight of each row as ``name``; null where a text has no words."""
    ratio = docs.sparkSession.sparkContext.broadcast(model.log_ratio)  # BUCKETS numbers
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    text = free_name(docs, "_text")

    def score(batches):
        for part in slices(batches, text):
            words = Words(part.column(text))
            w = _weights(ratio.value, words)
            at = part.schema.get_field_index(text)
            out = part.remove_column(at)
            yield out.append_column(name, pa.array(w, mask=np.diff(words.rows) == 0))

    given = docs.withColumn(text, F.col("text").cast("string"))
    return given.mapInArrow(score, schema)


def gumbel(key: Column) -> Column:
    """Standard Gumbel noise from a hash of ``key``; the same in every run."""
    u = (F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``log_weight``, ``gumbel_key`` and ``kept``.

    ``k`` is the number of rows to keep; without one it is the number of rows whose weight
    reaches the model's cut. Rows that tie with the last kept one are kept too, so repeated rows
    share one decision. A null or empty text (or one without words) has no weight and is not
    kept. A null doc_id draws its noise like any other value. Without labels of both classes
    every row with words is kept. Columns of ``docs`` with the names of the new ones are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("log_weight", "gumbel_key", "kept")])
    model = fit(docs, labels)
    keyed = lambda df, w: df.withColumn("gumbel_key", F.col(w) + gumbel(F.col("doc_id")))
    keys = stored(keyed(weigh(columns_of(docs, "doc_id", "text"), model, "log_weight"), "log_weight").select("log_weight", "gumbel_key").where("log_weight is not null"))
    n, above = keys.agg(F.count(F.lit(1)), F.count(F.when(F.col("log_weight") >= model.cut, 1))).first()
    size = min(above if k is None else k, n)
    last = float("inf")
    if size:
        placed = with_position(keys.select("gumbel_key"), [], ["gumbel_key"], "pos")
        last = placed.where(F.col("pos") == n - size).agg(F.min("gumbel_key")).first()[0]
    return keyed(weigh(docs, model, "log_weight"), "log_weight").withColumn(
        "kept", F.coalesce(F.col("gumbel_key") >= last, F.lit(False))
    )
