"""Shared pieces of the training-data operators: tables, shared folders, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.session import cut_lineage, drop_later, ensure_checkpoint_dir

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and, if it has one, its SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later passes read it, columns and filters are pushed down,
    and a lost executor costs a read. It is deleted when the process ends."""
    path = drop_later(shared_path(df.sparkSession, name))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` for helper columns, with underscores before those that ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Arrow batches hold this much at most, so that a task's memory does not depend on the rows' size.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to ``BATCH`` where they are higher."""
    for key, most in BATCH.items():
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def in_tasks(fn, schema, *args):
    """``df.transform(in_tasks(fn, schema, ...))``: apply ``fn(batch, ...)`` -> iterable of
    Arrow batches to each Arrow batch of a frame."""
    def step(df: DataFrame) -> DataFrame:
        bounded_batches(df.sparkSession)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from fn(batch, *args)
        return df.mapInArrow(run, schema)
    return step


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component = smallest node reachable).

    Alternates large-star and small-star steps; each round's edges go to the
    reliable checkpoint folder, so a lost executor costs a re-read. The number
    of rounds grows with the logarithm of the longest path. Nodes without an
    edge to another node are absent. Nothing but two numbers a round (edge
    count and checksum) reaches the driver.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e)
    last = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == last or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
                .union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        last = now
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (a written table: both sides of the join are then shuffled, so that Spark can split a hot node's neighbours)
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours, and the node, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = cut_lineage(small.filter("u <> v").distinct())


def link_labels(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) arrays: every linked node with the smallest id that it reaches inside
    one block pair. A block pair so sends at most one edge a node: dense groups never emit
    all their pairs."""
    rows, cols = linked.any(1), linked.any(0)
    linked, a, b = linked[rows][:, cols], ids_a[rows], ids_b[cols]
    if not len(a):
        return a, a
    top = np.iinfo(a.dtype).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(linked, na[:, None], top).min(0))
        if (na == la).all() and (nb == lb).all():
            return np.concatenate((a, b)), np.concatenate((na, nb))
        la, lb = na, nb
