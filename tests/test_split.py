import hashlib
import random

import pytest

from ranklab.operators import split as sp


def _brute_positions(data, key):
    order = sorted(range(len(data)), key=lambda i: key(data[i]))
    return {data[i][0]: pos for pos, i in enumerate(order)}


def _frame(spark, n=500, hot_share=0.34, seed=3):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        ts = 1000 if rnd.random() < hot_share else rnd.randint(0, 5000)  # one hot timestamp
        data.append((i, f"u{rnd.randint(0, 20)}", ts))
    return data, spark.createDataFrame(data, "rid long, USER_ID string, TIMESTAMP long")


def test_temporal_matches_brute_force(spark):
    data, df = _frame(spark)
    out = {r["rid"]: r["split"] for r in sp.temporal_split(df, 0.2, 0.3, "TIMESTAMP", ["rid"]).collect()}
    n = len(data)
    n_test, n_valid = int(n * 0.3), int(n * 0.2)
    pos = _brute_positions(data, lambda r: (r[2], r[0]))
    for rid, p in pos.items():
        want = "train" if p < n - n_valid - n_test else ("valid" if p < n - n_test else "test")
        assert out[rid] == want


def test_temporal_sizes_are_floors(spark):
    data, df = _frame(spark, n=46049 // 100)
    counts = {r["split"]: r["n_rows"] for r in sp.split_info(sp.temporal_split(df, 0.1, 0.1, "TIMESTAMP", ["rid"]))
              .collect()}
    n = len(data)
    assert counts["test"] == n // 10 and counts["valid"] == n // 10 and sum(counts.values()) == n


def test_random_split_matches_brute_force(spark):
    data, df = _frame(spark, n=400)
    out = {r["rid"]: r["split"] for r in sp.random_split(df, 0.25, 0.15, 9, key_cols=["rid"]).collect()}
    h = {r[0]: hashlib.md5(f"9|{r[0]}".encode()).hexdigest() for r in data}
    order = sorted(h, key=lambda k: (h[k], k))
    nv, nt = int(400 * 0.25), int(400 * 0.15)
    for p, rid in enumerate(order):
        want = "valid" if p < nv else ("test" if p < nv + nt else "train")
        assert out[rid] == want


def test_leave_last_n(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 0, 10), ("b", 1, 11)],
                               "USER_ID string, TIMESTAMP long, rid long")
    out = {r["rid"]: r["split"] for r in sp.leave_last_n_per_user(df, 1, 1, tiebreak=["rid"]).collect()}
    assert out[4] == "test" and out[3] == "valid" and out[2] == "train"
    assert out[10] == "train" and out[11] == "train"  # too short for a hold-out


def test_holdout_report_counts_short_users(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 0, 10), ("b", 1, 11)],
                               "USER_ID string, TIMESTAMP long, rid long")
    r = sp.holdout_report(sp.leave_last_n_per_user(df, 1, 1, tiebreak=["rid"])).first()
    assert (r["n_users"], r["n_users_without_holdout"], r["n_users_with_holdout"]) == (2, 1, 1)


def test_random_per_user_keeps_every_user_in_train(spark):
    data, df = _frame(spark, n=300)
    s = sp.random_split_per_user(df, 0.2, 0.2, 1, key_cols=["rid"])
    train_users = {r["USER_ID"] for r in s.filter("split = 'train'").select("USER_ID").distinct().collect()}
    assert train_users == {r[1] for r in data}


def test_users_out_is_disjoint(spark):
    _, df = _frame(spark, n=300)
    s = sp.leave_n_users_out(df, 3, 2, random_state=5)
    per_user = s.groupBy("USER_ID").agg({"split": "count"}).count()
    splits = s.select("USER_ID", "split").distinct()
    assert splits.count() == per_user  # every user in exactly one split
    assert splits.filter("split = 'valid'").count() == 3 and splits.filter("split = 'test'").count() == 2


def test_splits_complete_and_disjoint(spark):
    data, df = _frame(spark)
    s = sp.temporal_split(df, 0.1, 0.1, "TIMESTAMP", ["rid"])
    assert s.count() == len(data) and s.select("rid").distinct().count() == len(data)


def test_degenerate_split_guard(spark):
    df = spark.createDataFrame([(f"u{i}", i % 2, i) for i in range(20)], "USER_ID string, x long, TIMESTAMP long")
    s = sp.leave_last_n_per_user(df, 1, 1)
    with pytest.raises(sp.DegenerateSplit, match="single row"):
        sp.check_not_degenerate(s)


def test_guards():
    with pytest.raises(ValueError):
        sp._check_fractions(0.6, 0.5)
    with pytest.raises(ValueError):
        sp.split(None, "nope")


def test_cumulative_before_weighted(spark):
    df = spark.createDataFrame([(k, w) for k, w in [(3, 5), (1, 2), (2, 7), (9, 1)]], "k long, w long")
    out = {r["k"]: r["_before"] for r in sp.cumulative_before(df.repartition(3), ["k"], weight="w").collect()}
    assert out == {1: 0, 2: 2, 3: 9, 9: 14}


def test_random_per_user_matches_brute_force_with_hot_user(spark):
    rnd = random.Random(8)
    data = [(i, "hot" if rnd.random() < 0.34 else f"u{rnd.randint(0, 15)}", 0) for i in range(900)]
    df = spark.createDataFrame(data, "rid long, USER_ID string, TIMESTAMP long")
    out = {r["rid"]: r["split"] for r in sp.random_split_per_user(df, 0.2, 0.1, 4, key_cols=["rid"]).collect()}
    by_user = {}
    for rid, u, _ in data:
        by_user.setdefault(u, []).append(rid)
    for u, rids in by_user.items():
        order = sorted(rids, key=lambda r: (hashlib.md5(f"4|{r}".encode()).hexdigest(), r))
        n = len(order)
        nv, nt = int(n * 0.2), int(n * 0.1)
        for p, rid in enumerate(order):
            assert out[rid] == ("valid" if p < nv else "test" if p < nv + nt else "train")


def test_temporal_split_on_timestamp_column(spark):
    from pyspark.sql import functions as F
    data, df = _frame(spark, n=300)
    ts = df.withColumn("TIMESTAMP", F.timestamp_add("SECOND", F.col("TIMESTAMP"),
                                                    F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")))
    a = {r["rid"]: r["split"] for r in sp.temporal_split(df, 0.2, 0.2, "TIMESTAMP", ["rid"]).collect()}
    b = {r["rid"]: r["split"] for r in sp.temporal_split(ts, 0.2, 0.2, "TIMESTAMP", ["rid"]).collect()}
    assert a == b
