"""Sources: graphs as Parquet tables, transaction and card logs as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ringsight.functions.ordered import with_position
from ringsight.graph import FraudGraph

EDGE_SCHEMA = T.StructType([
    T.StructField("edge_id", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
    T.StructField("edge_type", T.IntegerType()), T.StructField("ts", T.IntegerType()),
])
# Column order and types of the two CSV logs.
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("Time", T.IntegerType()), T.StructField("Source", T.StringType()),
    T.StructField("Target", T.StringType()), T.StructField("Amount", T.FloatType()),
    T.StructField("Location", T.StringType()), T.StructField("Type", T.StringType()),
    T.StructField("Labels", T.IntegerType()),
])
CARD_COLUMNS = ["card_id", "loc_cty", "loc_merch", "time_stamp", "amt_grant", "amt_purch", "is_fraud"]
CARD_SCHEMA = T.StructType([
    T.StructField("card_id", T.LongType()), T.StructField("loc_cty", T.LongType()), T.StructField("loc_merch", T.LongType()),
    T.StructField("time_stamp", T.StringType()), T.StructField("amt_grant", T.DoubleType()),
    T.StructField("amt_purch", T.DoubleType()), T.StructField("is_fraud", T.IntegerType()),
])


def node_schema(features: int) -> T.StructType:
    return T.StructType([
        T.StructField("node_id", T.LongType()), *[T.StructField(f"f{i}", T.DoubleType()) for i in range(features)],
        T.StructField("label", T.IntegerType()), T.StructField("split", T.StringType()),
    ])


def read_graph(spark: SparkSession, nodes: str, edges: str, features: int) -> FraudGraph:
    """Nodes and edges with declared schemas; ids are columns of the files."""
    return FraudGraph(
        spark.read.schema(node_schema(features)).parquet(nodes), spark.read.schema(EDGE_SCHEMA).parquet(edges)
    )


def _in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Number the rows by file, place in the file and order inside the place."""
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    return with_position(placed, [], ["_file", "_start", "_seen"], name).drop("_file", "_start", "_seen")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The transaction log with ``row_id``, the row's place in the files."""
    return _in_file_order(spark.read.schema(TRANSACTION_SCHEMA).csv(path, header=True), "row_id")


def read_card_log(spark: SparkSession, path: str) -> DataFrame:
    """S3: the card log with a parsed time stamp and ``row_id``."""
    rows = spark.read.schema(CARD_SCHEMA).csv(path, header=True)
    return _in_file_order(rows, "row_id").withColumn("time_stamp", F.to_timestamp("time_stamp"))
