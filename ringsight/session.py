"""Session settings and lineage cuts shared by the operators."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the run-time work the operators rely on: it coalesces small
# partitions, splits skewed join partitions (also where that costs one more shuffle) and
# turns a join into a broadcast only when the measured size is under the threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "ringsight", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="ringsight-checkpoint-")
    sc.setCheckpointDir(named)
    return named


PAUSE = 10.0  # seconds between collections
_collected = [0.0]


def drop_unused(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints nothing refers to any more.

    It does so when the driver's heap is collected, which a driver with little to do may not be for half an hour.
    """
    if time.monotonic() - _collected[0] >= PAUSE:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written rows.

    Needed where rows must not change when a lost executor is replaced (positions taken from
    range partitions) and in iterations, whose plans would otherwise double at every step.
    """
    checkpoint_dir(df.sparkSession)
    drop_unused(df.sparkSession)
    return df.checkpoint(eager=True)
