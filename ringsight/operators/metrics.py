"""Exact ranking and threshold metrics over ``(keys.., y, p)``.

Scores are first counted per distinct value; running sums over the values then give every
threshold at once, without sorting in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.ordered import running_sums
from ringsight.functions.scalars import safe_div


def _div(a: Column, b: Column) -> Column:
    return safe_div(a, b)


def confusion_metrics(scored: DataFrame, keys: list[str] = (), threshold: float = 0.5) -> DataFrame:
    """Q1: confusion counts and the rates built on them."""
    hit, pos = F.col("p") > threshold, F.col("y") == 1
    counts = scored.groupBy(*keys).agg(
        F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn), "specificity": _div(tn, tn + fp),
        "f1": _div(2 * tp, 2 * tp + fp + fn), "accuracy": _div(tp + tn, tp + tn + fp + fn),
    })


def threshold_curve(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per distinct score, from high to low: counts ``pos, neg``, running ``tp, fp`` and the totals."""
    keys = list(keys)
    counted = scored.groupBy(*keys, "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    curve = running_sums(counted, keys, ["p"], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    totals = scored.groupBy(*keys).agg(
        F.count_if(F.col("y") == 1).cast("double").alias("n_pos"), F.count_if(F.col("y") != 1).cast("double").alias("n_neg")
    )
    if keys:
        return curve.join(totals, keys)
    sizes = totals.select(F.struct("n_pos", "n_neg").alias("s")).scalar()
    return curve.withColumns({"n_pos": sizes["n_pos"], "n_neg": sizes["n_neg"]})


def _area(curve: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    return curve.groupBy(*keys).agg(F.sum(value).alias(name))


def _auc_term() -> Column:
    # Positives at this score outrank the negatives below it and tie with those at it.
    below = F.col("n_neg") - F.col("fp")
    return F.try_divide(F.col("pos") * (below + F.col("neg") / 2), F.col("n_pos") * F.col("n_neg"))


def _ap_term() -> Column:
    return _div(F.col("pos"), F.col("n_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))


def _pr_term() -> Column:
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(F.try_divide(tp0.cast("double"), tp0 + fp0))
    return _div(F.col("pos"), F.col("n_pos")) * (now + before) / 2


def roc_auc(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Q2: area under the ROC curve, ties counted half; null when only one class is present."""
    return _area(threshold_curve(scored, keys), list(keys), _auc_term(), "auc")


def average_precision(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Q3: step-wise average precision and the trapezoid area of the precision-recall curve."""
    curve = threshold_curve(scored, keys)
    return curve.groupBy(*keys).agg(F.sum(_ap_term()).alias("ap"), F.sum(_pr_term()).alias("pr_auc"))


def _macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (_div(2 * tp, 2 * tp + fp + fn) + _div(2 * tn, 2 * tn + fp + fn)) / 2


THRESHOLDS = [float(t) for t in np.linspace(0.05, 0.95, 19)]


def best_macro_f1(scored: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Q4: the best macro F1 over fixed thresholds; all of them are counted in one pass."""
    pos, p = F.col("y") == 1, F.col("p")
    counts = scored.agg(
        F.count_if(pos).alias("np"), F.count_if(~pos).alias("nn"),
        *[F.count_if(pos & (p > t)).alias(f"tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(~pos & (p > t)).alias(f"fp{i}") for i, t in enumerate(thresholds)],
    )
    cells = [
        F.struct(
            _macro_f1(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col("np") - F.col(f"tp{i}"), F.col("nn") - F.col(f"fp{i}")).alias("f1"),
            F.lit(-t).alias("order"),
        )
        for i, t in enumerate(thresholds)
    ]
    # Equal scores keep the lowest threshold.
    best = F.array_max(F.array(*cells))
    return counts.select(best["f1"].alias("best_macro_f1"), (-best["order"]).alias("threshold"))


def best_thresholds(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Q5: best macro F1 and best G-mean over all thresholds; ties keep the highest one."""
    curve = threshold_curve(scored, keys)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
    gmean = F.sqrt(_div(tp, F.col("n_pos")) * _div(tn, F.col("n_neg")))
    best = curve.groupBy(*keys).agg(
        F.max(F.struct(_macro_f1(tp, fp, fn, tn).alias("v"), F.col("p"))).alias("m"),
        F.max(F.struct(gmean.alias("v"), F.col("p"))).alias("g"),
    )
    return best.select(
        *keys, F.col("m.v").alias("mf1"), F.col("m.p").alias("th1"), F.col("g.v").alias("gme"), F.col("g.p").alias("th2")
    )


def threshold_report(scored: DataFrame, order: tuple[str, str, str] = ("trn", "val", "tst")) -> DataFrame:
    """Q5, three splits: train and validation at their own best threshold, test at validation's."""
    best = best_thresholds(scored.where(F.col("split").isin(*order[:2])), ["split"])
    used = best.unionByName(best.where(F.col("split") == order[1]).withColumn("split", F.lit(order[2])))
    hit, pos = F.col("p") > F.col("th1"), F.col("y") == 1
    counts = scored.join(F.broadcast(used.select("split", "th1")), "split").groupBy("split").agg(
        F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"),
    )
    ranks = threshold_curve(scored, ["split"]).groupBy("split").agg(
        F.sum(_auc_term()).alias("auc"), F.sum(_ap_term()).alias("aps")
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    is_test = F.col("split") == order[2]
    return used.join(counts, "split").join(ranks, "split").select(
        "split", "auc", "aps",
        F.when(is_test, _macro_f1(tp, fp, fn, tn)).otherwise(F.col("mf1")).alias("mf1"), "th1",
        F.when(is_test, F.sqrt(_div(tp, tp + fn) * _div(tn, tn + fp))).otherwise(F.col("gme")).alias("gme"), "th2",
        _div(tp, tp + fn).alias("rec"), _div(tp, tp + fp).alias("pre"),
    )


def g_mean(labelled: DataFrame, truth: str = "y", predicted: str = "prediction") -> DataFrame:
    """Q6: geometric mean of the recall of every class; 0 when a class is never found."""
    recalls = labelled.groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    found = F.min("recall") > 0
    logs = F.avg(F.when(F.col("recall") > 0, F.log("recall")).otherwise(0.0))
    return recalls.agg(F.when(found, F.exp(logs)).otherwise(0.0).alias("g_mean"))


def fold_summary(scored: DataFrame) -> DataFrame:
    """Q7: mean and population std of AUC and F1 over the folds that hold both classes."""
    per_fold = roc_auc(scored, ["fold"]).join(confusion_metrics(scored, ["fold"]).select("fold", "f1"), "fold")
    return per_fold.where(F.col("auc").isNotNull()).agg(
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
        F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.count(F.lit(1)).alias("folds"),
    )
