"""Graph, transaction and score views over order, event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ringsight.functions.scalars import seeded_hash
from ringsight.graph import FraudGraph

RELATIONS = ("r1", "r2", "r3")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per order line: customer -> customer slot of the part, typed by flag and status."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer").agg(F.count(F.lit(1))).scalar()
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    status = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"),
        F.col("o_custkey").alias("src"),
        (F.col("l_partkey") % customers).alias("dst"),
        (flag + status).alias("edge_type"),
        (F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")) + 1).alias("ts"),
    )


def customer_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One node per customer: account, order statistics, a label and a hash split."""
    customer = table(spark, folder, "customer")
    price = F.col("o_totalprice")
    stats = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("o_orderkey").alias("n"),
        # Summed as decimals: the same total whatever the order of the rows.
        F.sum(price.cast("decimal(18,4)")).cast("double").alias("s"),
        (F.sum(price.cast("decimal(18,4)")).cast("double") / F.count(price)).alias("a"),
        F.max(price).alias("x"), F.min(price).alias("m"),
        F.countDistinct("o_orderpriority").alias("p"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
    )
    # The market segments are an enumeration; its sorted list gives each segment a code.
    segments = customer.select("c_mktsegment").distinct().agg(
        F.array_sort(F.collect_list("c_mktsegment"))
    ).scalar()
    hashed = seeded_hash("c_custkey")
    missing = lambda c: F.coalesce(F.col(c), F.lit(-1.0))
    return customer.join(stats, "c_custkey", "left").select(
        F.col("c_custkey").alias("node_id"),
        F.col("c_acctbal").alias("f0"),
        F.col("c_nationkey").cast("double").alias("f1"),
        (F.array_position(segments, F.col("c_mktsegment")) - 1).cast("double").alias("f2"),
        F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("f3"),
        missing("s").alias("f4"), missing("a").alias("f5"), missing("x").alias("f6"), missing("m").alias("f7"),
        F.coalesce(F.col("p"), F.lit(0)).cast("double").alias("f8"),
        F.coalesce(F.col("done"), F.lit(0)).cast("double").alias("f9"),
        F.when(F.col("c_acctbal") < 0, 1).when(F.col("c_mktsegment") == "BUILDING", 2)
        .when(F.col("c_mktsegment") == "MACHINERY", 3).otherwise(0).alias("label"),
        F.when(hashed < "9", "train").when(hashed < "d", "valid").otherwise("test").alias("split"),
    )


def order_graph(spark: SparkSession, folder: str) -> FraudGraph:
    return FraudGraph(customer_nodes(spark, folder), order_edges(spark, folder))


def with_gaps(graph: FraudGraph, seed: str = "null") -> FraudGraph:
    """The same graph with about a fifth of the feature values set to the missing value -1."""
    def gap(i: int, name: str):
        head = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(i)), F.col("node_id").cast("string"))), 1, 1)
        return F.when(head < "3", F.lit(-1.0)).otherwise(F.col(name)).alias(name)

    features = {name: gap(i, name) for i, name in enumerate(graph.feature_names)}
    return FraudGraph(graph.nodes.withColumns(features), graph.edges)


def relation_edges(edges: DataFrame) -> DataFrame:
    """Edges with a relation name, two edge types per relation."""
    pair = F.floor(F.col("edge_type") / 2)
    return edges.withColumn("relation", F.when(pair == 0, "r1").when(pair == 1, "r2").otherwise("r3"))


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The transaction log: one row per event."""
    seconds = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    label = F.when(F.col("event_id") % 5 == 0, 2).when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"),
        (seconds - start).alias("Time"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("Source"),
        F.concat(F.lit("T"), (F.col("event_id") % 37).cast("string")).alias("Target"),
        F.col("value").alias("Amount"),
        F.concat(F.lit("L"), (95 + F.col("event_id") % 60).cast("string")).alias("Location"),
        F.col("event_type").alias("Type"),
        label.alias("Labels"),
    )


def order_cards(spark: SparkSession, folder: str) -> DataFrame:
    """The card log: one row per order."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("card_id"),
        F.col("c_nationkey").alias("loc_cty"), F.col("o_custkey").alias("loc_merch"),
        F.col("o_orderdate").cast("timestamp").alias("time_stamp"),
        F.col("o_totalprice").alias("amt_grant"), (F.col("o_totalprice") * 0.8).alias("amt_purch"),
        (F.col("c_acctbal") < 0).cast("int").alias("is_fraud"),
    )


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled scores: ``(id, y, p, fold)``."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("y"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("p"),
        (F.col("doc_id") % 5).cast("int").alias("fold"),
    )
