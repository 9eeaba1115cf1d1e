"""Readers for the shared test tables and the recommender views built on them.

The views only project and join; Catalyst pushes the column selection and
any later filter into the Parquet scans.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.functions.columns import epoch_micros, epoch_seconds

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Columns that make one `inter` row unique; used as the deterministic tiebreak
# wherever the reference relied on file order.
INTER_TIEBREAK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def interactions(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """`inter`: one row per order line as a (user, item, outcome, time) interaction; with ``orders``, the lines of those orders only."""
    # the outcome before the join: a double is narrower there than the flag's text
    li = table(spark, sf_dir, "lineitem").withColumn("OUTCOME", (F.col("l_returnflag") == "R").cast("double"))
    od = (table(spark, sf_dir, "orders") if orders is None else orders).select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    return j.select(
        F.col("o_custkey").cast("string").alias("USER_ID"),
        F.col("l_partkey").cast("string").alias("ITEM_ID"),
        "OUTCOME",
        epoch_seconds("o_orderdate").alias("TIMESTAMP"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("OUTCOME_revenue"),
        *[F.col(c) for c in INTER_TIEBREAK],
    )


def orders_when(spark: SparkSession, sf_dir: str, keep: Column) -> DataFrame:
    """The orders whose TIMESTAMP, as in `inter`, passes ``keep``."""
    return table(spark, sf_dir, "orders").withColumn("TIMESTAMP", epoch_seconds("o_orderdate")).filter(keep).select(
        "o_orderkey", "o_custkey", "o_orderdate")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ev`: click-stream events; ITEM_ID is the event type, ts in epoch microseconds."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("USER_ID"),
        F.col("event_type").alias("ITEM_ID"),
        F.col("value").alias("OUTCOME"),
        epoch_micros("ts").alias("TIMESTAMP"),
        F.col("event_id"),
    )


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`prio`: orders as (customer, priority, big-order flag)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("USER_ID"),
        F.col("o_orderpriority").alias("ITEM_ID"),
        (F.col("o_totalprice") > 200000.0).cast("double").alias("OUTCOME"),
        epoch_seconds("o_orderdate").alias("TIMESTAMP"),
        F.col("o_orderkey"),
    )


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lab`: wide two-target table (quality, toxic) with document features."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("USER_ID"),
        F.col("quality").cast("double").alias("ITEM_quality"),
        F.col("toxic").cast("double").alias("ITEM_toxic"),
        "lang", "n_chars",
    )


def customer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cls`: customer -> market segment as a multiclass contract."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("USER_ID"),
                    F.col("c_mktsegment").alias("ITEM_ID"),
                    "c_nationkey", "c_acctbal")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("USER_ID"),
                    F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"),
                    F.col("c_mktsegment").alias("segment"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("ITEM_ID"),
                    F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"),
                    F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice"))
