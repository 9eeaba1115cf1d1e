"""What splits and models read: the interactions' join runs once, however often its rows are read."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ranklab.operators import split
from ranklab.operators.split import temporal_split
from ranklab.plans import catalog, reg_data, registering
from ranklab.session import materialize
from ranklab.sources import tables as T


@pytest.fixture
def tables(spark, tmp_path):
    orders = [(o, o % 7, "2000-01-%02d 00:00:00" % (1 + o % 28), 1.0, "1-URGENT") for o in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double, o_orderpriority string") \
        .withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(o, p % 5, 1, p, float(p), 10.0 * p, 0.1, "R" if p % 2 else "N") for o in range(60) for p in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def read_by(frame):
    return {os.path.basename(os.path.dirname(f)) for f in frame.inputFiles()}


def test_splits_read_the_join_once(spark, tables, monkeypatch):
    seen = []

    def spy(split):
        def run(df, *a, **kw):
            seen.append(read_by(df))
            return split(df, *a, **kw)
        return run
    monkeypatch.setattr(registering, "temporal_split", spy(registering.temporal_split))
    monkeypatch.setattr(reg_data.sp, "temporal_split", spy(reg_data.sp.temporal_split))
    train, valid = registering.temporal_parts(spark, tables)
    assert train.count() == 192 and valid.count() == 24 and train.columns == T.interactions(spark, tables).columns
    assert train.agg(F.max("TIMESTAMP")).first()[0] <= valid.agg(F.min("TIMESTAMP")).first()[0]
    for q in (reg_data.q_split_temporal, reg_data.q_split_temporal_uneven):
        assert sum(r["n_rows"] for r in q(spark, tables).collect()) == 240
    assert len(seen) == 3 and not any(f & {"lineitem.parquet", "orders.parquet"} for f in seen)


@pytest.mark.parametrize("days", [1, 3, 40])
def test_narrow_parts_hold_the_rows_of_the_whole_split(spark, tmp_path, days):
    """Cuts fall inside few large days (days = 1: all rows of one time), among equal rows and rows that differ in no tiebreak."""
    orders = [(o, o % 7, "2000-02-%02d" % (1 + o % days) if days < 28 else "2000-%02d-05" % (1 + o % 12), 1.0, "1-URGENT") for o in range(50)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double, o_orderpriority string") \
        .withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(o, None if p == 4 else 3, 1, 1, 1.0, 10.0, (p // 2) / 10, "RNA"[p % 3]) for o in range(50) for p in range(7) for _ in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    cols = ["USER_ID", "ITEM_ID", "OUTCOME", "OUTCOME_revenue"]
    for sizes in ((0.1, 0.1), (0.0, 0.37), (0.33, 0.0)):
        whole = temporal_split(T.interactions(spark, str(tmp_path)), *sizes, "TIMESTAMP", T.INTER_TIEBREAK)
        parts = dict(zip(("train", "valid"), registering.temporal_parts(spark, str(tmp_path), *sizes, cols=cols)))
        for name, part in parts.items():
            assert part.columns == cols
            want = whole.filter(F.col("split") == name).select(cols)
            assert Counter(map(tuple, part.collect())) == Counter(map(tuple, want.collect())), (name, sizes)


@pytest.mark.parametrize("query, written", [("off_policy_popularity", {"USER_ID", "l_partkey", "OUTCOME", "TIMESTAMP"}),
                                            ("flagship_leaderboard", {"USER_ID", "l_partkey", "OUTCOME", "TIMESTAMP"}),
                                            ("regression_revenue", {"l_partkey", "OUTCOME_revenue", "TIMESTAMP"})])
def test_only_what_is_read_is_written_before_a_split(spark, tables, tmp_path, monkeypatch, query, written):
    eleven = F.expr("timestampadd(DAY, o_orderkey % 11, TIMESTAMP_NTZ'2000-01-01 00:00:00')")   # both cuts fall inside a day
    spark.read.parquet(f"{tables}/orders.parquet").withColumn("o_orderdate", eleven).write.parquet(f"{tmp_path}/cut/orders.parquet")
    spark.read.parquet(f"{tables}/lineitem.parquet").write.parquet(f"{tmp_path}/cut/lineitem.parquet")
    seen = {}

    def spy(df, name, *a, **kw):
        seen.setdefault(name, []).append(df)
        return materialize(df, name, *a, **kw)
    monkeypatch.setattr(registering, "materialize", spy)
    monkeypatch.setattr(split, "materialize", spy)
    assert catalog.queries()[query](spark, f"{tmp_path}/cut").count() > 0
    (rows,), (orders,) = seen["interactions"], seen["edge-orders"]
    assert set(rows.columns) == written and rows.count() == 240
    assert orders.count() == 10 and seen["edge-rows"][0].count() == 40   # of 60 orders, those of the two days cut
