"""Splits stay positional through ties, equal rows and nulls."""

from collections import Counter

import pytest

from ranklab.operators import split as sp


def sizes(df):
    return Counter(r["split"] for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "USER_ID string, ITEM_ID string, TIMESTAMP long, t int").repartition(3)


def test_one_timestamp_without_tiebreak(spark):
    df = frame(spark, [(f"u{i % 3}", f"i{i}", 7, i) for i in range(12)])
    assert sizes(sp.temporal_split(df, .25, .25)) == {"train": 6, "valid": 3, "test": 3}
    assert sizes(sp.leave_last_n_per_user(df, 1, 1)) == {"train": 6, "valid": 3, "test": 3}


def test_equal_rows(spark):
    df = frame(spark, [("u", "i", 7, 1)] * 20)
    assert sizes(sp.random_split(df, .25, .25)) == {"train": 10, "valid": 5, "test": 5}
    assert sizes(sp.temporal_split(df, .25, .25)) == {"train": 10, "valid": 5, "test": 5}
    assert sizes(sp.leave_last_n_per_user(df, 2, 1)) == {"train": 17, "valid": 2, "test": 1}


def test_equal_rows_inside_one_split_are_not_cut(spark):
    df = frame(spark, [("u", "a", 1, 0)] * 6 + [("u", "b", 2, 0)] * 3 + [("u", "c", 3, 0)] * 3)
    got = Counter((r["ITEM_ID"], r["split"]) for r in sp.temporal_split(df, .25, .25).collect())
    assert got == {("a", "train"): 6, ("b", "valid"): 3, ("c", "test"): 3}
    got = Counter((r["ITEM_ID"], r["split"]) for r in sp.leave_last_n_per_user(df, 4, 1).collect())
    assert got == {("a", "train"): 6, ("b", "valid"): 2, ("b", "train"): 1, ("c", "valid"): 2, ("c", "test"): 1}


def test_null_tiebreak_and_null_user(spark):
    df = frame(spark, [(None if i % 4 == 0 else "u", "i", 7, None if i % 2 else i) for i in range(12)])
    assert sizes(sp.temporal_split(df, .25, .25, tiebreak=["t"])) == {"train": 6, "valid": 3, "test": 3}
    assert sizes(sp.leave_last_n_per_user(df, 1, 1, tiebreak=["t"])) == {"train": 8, "valid": 2, "test": 2}


def test_users_out_sizes(spark):
    df = frame(spark, [(f"u{i % 10}", "i", i, i) for i in range(50)])
    got = sp.leave_n_users_out(df, 2, 3)
    assert sizes(got.select("USER_ID", "split").distinct()) == {"valid": 2, "test": 3, "train": 5}


def test_dispatcher_refuses_an_empty_validation_part(spark):
    df = frame(spark, [(f"u{i}", "i", i, i) for i in range(20)])
    with pytest.raises(sp.DegenerateSplit, match="single row"):
        sp.split(df, "leave_last_n_per_user", n_valid=1, n_test=1)
    assert sizes(sp.split(df, "leave_last_n_per_user", check=False, n_valid=1, n_test=1)) == {"train": 20}
    assert sizes(sp.split(df, "temporal", valid_fraction=.1, test_fraction=.1)) == {"train": 16, "valid": 2, "test": 2}
