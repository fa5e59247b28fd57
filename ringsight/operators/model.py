"""Cross-validated boosted trees, the ensemble of its folds, class weights and importances."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ringsight.functions.scalars import finite, total
from ringsight.operators.metrics import fold_summary
from ringsight.operators.splits import split_kfold
from ringsight.session import cut_lineage


@dataclass(frozen=True)
class BoostSettings:
    # The published training configuration, as far as the trainer has the setting.
    iterations: int = 2500
    learning_rate: float = 0.06
    depth: int = 5
    bins: int = 254
    subsample: float = 0.85
    folds: int = 5
    seed: int = 2022
    tolerance: float = 1e-4


@dataclass(frozen=True)
class Ensemble:
    models: list[GBTClassificationModel]
    columns: list[str]
    settings: BoostSettings = field(default_factory=BoostSettings)

    def save(self, path: str) -> None:
        """One model folder per fold and the column order as JSON."""
        for i, model in enumerate(self.models, start=1):
            model.write().overwrite().save(f"{path}/fold_{i}")
        spark = SparkSession.getActiveSession()
        note = json.dumps({"columns": self.columns, "settings": asdict(self.settings)})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> "Ensemble":
        spark = SparkSession.getActiveSession()
        note = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        settings = BoostSettings(**note["settings"])
        models = [GBTClassificationModel.load(f"{path}/fold_{i}") for i in range(1, settings.folds + 1)]
        return cls(models, note["columns"], settings)


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """V3: n / (2 n_c) per class, and the ratio of negatives to positives."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    sums = rows.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")
    )).scalar()
    return counts.select(
        label, "n_class", (sums["n"] / (2 * F.col("n_class"))).alias("weight"),
        F.try_divide((sums["n"] - sums["pos"]).cast("double"), sums["pos"]).alias("neg_pos_ratio"),
    )


def assembled(table: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    clean = table.select(*keep, *[finite(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(columns)])
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(columns))], outputCol="_v").transform(clean).select(*keep, "_v")


def train_cv(
    table: DataFrame, columns: list[str], settings: BoostSettings = BoostSettings()
) -> tuple[Ensemble, DataFrame]:
    """V1: one boosted model per stratified fold, with balanced weights and early stopping.

    ``table(node_id, label, columns..)`` with labels 0 and 1. Returns the models and the held-out
    predictions ``(node_id, y, p, fold)``, one per row.
    """
    folds = split_kfold(table.select("node_id", "label"), settings.folds, settings.seed).select("node_id", "fold")
    weights = class_weights(table)
    rows = assembled(table, columns, ["node_id", "label"]).join(folds, "node_id").join(
        F.broadcast(weights.select("label", "weight")), "label"  # one row per class
    )
    rows = cut_lineage(rows.withColumn("label", F.col("label").cast("double")))
    models, held = [], []
    for fold in range(settings.folds):
        trainer = GBTClassifier(
            featuresCol="_v", labelCol="label", weightCol="weight", validationIndicatorCol="held",
            maxIter=settings.iterations, stepSize=settings.learning_rate, maxDepth=settings.depth, maxBins=settings.bins,
            subsamplingRate=settings.subsample, validationTol=settings.tolerance, seed=settings.seed,
        )
        marked = rows.withColumn("held", F.col("fold") == fold)
        model = trainer.fit(marked)
        models.append(model)
        held.append(scored(model, marked.where("held"), ["node_id", "label", "fold"]))
    out = held[0]
    for part in held[1:]:
        out = out.unionByName(part)
    return Ensemble(models, columns, settings), out.select("node_id", F.col("label").cast("int").alias("y"), "p", "fold")


def scored(model: GBTClassificationModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("p"))


def ensemble_predict(ensemble: Ensemble, table: DataFrame) -> DataFrame:
    """V2: probability of every fold model and their mean, in one pass over the rows."""
    rows = assembled(table, ensemble.columns, ["node_id"])
    for i, model in enumerate(ensemble.models, start=1):
        fold = model.copy()
        fold.setPredictionCol(f"_y{i}").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}")
        rows = fold.transform(rows)
    parts: list[Column] = [vector_to_array(f"_p{i}")[1] for i in range(1, len(ensemble.models) + 1)]
    return rows.select(
        "node_id", (total(parts) / F.lit(float(len(parts)))).alias("p"), *[p.alias(f"p_fold_{i}") for i, p in enumerate(parts, start=1)]
    )


def feature_importance(ensemble: Ensemble) -> DataFrame:
    """V4: importance of every feature averaged over the folds, largest first."""
    spark = SparkSession.getActiveSession()
    cells = [
        (name, fold, float(value))
        for fold, model in enumerate(ensemble.models)
        for name, value in zip(ensemble.columns, model.featureImportances.toArray())
    ]
    table = spark.createDataFrame(cells, "feature string, fold int, importance double")
    return table.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def cv_metrics(held_out: DataFrame) -> DataFrame:
    """Mean and spread of AUC and F1 over the folds of the held-out predictions."""
    return fold_summary(held_out)
