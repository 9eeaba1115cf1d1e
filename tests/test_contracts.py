import pytest

from ranklab.operators import profile as pf
from ranklab.operators import validate as vd
from ranklab.plans import bundle as bd
from ranklab.plans.contracts import contract_from_columns, contract_from_dataframe, dataset_type, generate_schema
from ranklab.plans.transform import transform
from tests.conftest import rows


@pytest.mark.parametrize("cols,contract,dtype", [
    (["USER_ID", "ITEM_ID", "OUTCOME"], "long_interactions", "interactions"),
    (["USER_ID", "ITEM_ID", "OUTCOME", "TIMESTAMP"], "long_with_timestamp", "interactions"),
    (["USER_ID", "ITEM_ID", "OUTCOME", "OUTCOME_rev"], "long_multi_reward", "interactions"),
    (["USER_ID", "ITEM_a", "ITEM_b"], "wide_multioutput", "interaction_multioutput"),
    (["USER_ID", "ITEM_ID", "feat1"], "multiclass", "interaction_multiclass"),
    (["USER_ID", "ITEM_SEQUENCE"], "prebuilt_sequences", "interactions"),
    (["USER_ID", "SESSION_SEQUENCES"], "sessions", "interactions"),
    (["USER_ID", "ITEM_ID", "OUTCOME", "TIMESTAMP", "OUTCOME_x"], "long_with_timestamp", "interactions"),
])
def test_contract_table(cols, contract, dtype):
    assert contract_from_columns(cols) == contract
    assert dataset_type(contract) == dtype


def test_empty_is_unknown(spark):
    df = spark.createDataFrame([], "USER_ID string, ITEM_ID string, OUTCOME double")
    assert contract_from_dataframe(df) == "unknown"


def test_schema_overrides(spark):
    df = spark.createDataFrame([(1, 2, 1, 0)], "USER_ID long, ITEM_ID long, OUTCOME long, ITEM_SEQUENCE_len long")
    s = {f.name: f.dataType.simpleString() for f in generate_schema(df).fields}
    assert s["USER_ID"] == "string" and s["ITEM_ID"] == "string" and s["OUTCOME"] == "double"


def test_long_rename_path(spark):
    df = spark.createDataFrame([("u1", "i_a", 1), ("u1", "i_b", 0), ("u2", "i_a", 1), ("u3", "i_c", 1)],
                               "uid string, iid string, rew long")
    out, rep = transform(df, "long_interactions", user_id_column="uid", item_id_column="iid", outcome_column="rew")
    assert sorted(out.columns) == ["ITEM_ID", "OUTCOME", "USER_ID"] and rep["n_rows"] == 4
    assert dict(out.dtypes)["OUTCOME"] == "double"


def test_long_with_time(spark):
    df = spark.createDataFrame([("u1", "i_a", 1, "2024-01-01"), ("u1", "i_b", 0, "2024-01-02"),
                                ("u2", "i_a", 1, "2024-01-01")], "uid string, iid string, rew long, event_time string")
    out, _ = transform(df, "long_with_timestamp", user_id_column="uid", item_id_column="iid", outcome_column="rew",
                       timestamp_column="event_time")
    assert "TIMESTAMP" in out.columns and "event_time" not in out.columns


def test_wide_label_prefix(spark):
    df = spark.createDataFrame([("u1", 1, 1, 0, 1), ("u2", 2, 0, 1, 1), ("u3", 3, 1, 1, 0)],
                               "company_id string, feat1 long, label_payroll long, label_invoice long, label_budget long")
    out, rep = transform(df, "wide_multioutput", user_id_column="company_id", target_rename_pattern=r"label_(.*)")
    assert {"ITEM_payroll", "ITEM_invoice", "ITEM_budget", "feat1"} <= set(out.columns)
    assert rep["n_rows"] == 3


def test_wide_to_long_by_regex(spark):
    df = spark.createDataFrame([("u1", 10, 1, 0, 1), ("u2", 20, 0, 1, 1)],
                               "company_id string, feat1 long, label_a long, label_b long, label_c long")
    out, _ = transform(df, "long_interactions", user_id_column="company_id", target_rename_pattern=r"label_.*")
    assert out.count() == 6
    assert {r["ITEM_ID"] for r in out.collect()} == {"label_a", "label_b", "label_c"}


def test_wide_to_long_explicit(spark):
    df = spark.createDataFrame([("u1", "x", 1, 0), ("u2", "y", 0, 1)], "uid string, ignored string, click long, purchase long")
    out, _ = transform(df, "long_interactions", user_id_column="uid", target_columns=["click", "purchase"])
    assert out.count() == 4


def test_rename_and_melt_conflict(spark):
    df = spark.createDataFrame([("u1", "x", 1)], "uid string, iid string, click long")
    with pytest.raises(ValueError, match="give one of them"):
        transform(df, "long_interactions", user_id_column="uid", item_id_column="iid", target_columns=["click"])


def test_multiclass(spark):
    df = spark.createDataFrame([("u1", "A"), ("u2", "B")], "uid string, iid string")
    out, _ = transform(df, "multiclass", user_id_column="uid", item_id_column="iid")
    assert sorted(out.columns) == ["ITEM_ID", "USER_ID"]


def test_sequences(spark):
    df = spark.createDataFrame([("a", "x", 100), ("a", "y", 200), ("a", "z", 300), ("b", "x", 100)],
                               "u string, i string, ts long")
    out, _ = transform(df, "prebuilt_sequences", user_id_column="u", item_id_column="i", timestamp_column="ts")
    got = {r["USER_ID"]: r["ITEM_SEQUENCE"] for r in out.collect()}
    assert got == {"a": ["x", "y", "z"], "b": ["x"]}


def test_users_and_items_features(spark):
    u = spark.createDataFrame([("a", 30), ("a", 30), ("b", 25)], "uid string, age long")
    out, rep = transform(u, "users_features", user_id_column="uid")
    assert rep["n_rows"] == 2
    i = spark.createDataFrame([("a", "x"), ("b", "y")], "iid string, category string")
    out, rep = transform(i, "items_features", item_id_column="iid")
    assert rep["n_rows"] == 2 and "ITEM_ID" in out.columns


def test_multi_reward(spark):
    df = spark.createDataFrame([("u1", "A", 1, 10.0), ("u2", "B", 0, 0.0)], "uid string, iid string, rew long, revenue double")
    out, _ = transform(df, "long_multi_reward", user_id_column="uid", item_id_column="iid", outcome_column="rew",
                       auxiliary_outcome_columns=["revenue"])
    assert "OUTCOME_revenue" in out.columns


def test_sessions_missing(spark):
    df = spark.createDataFrame([("a", 1)], "USER_ID string, x long")
    with pytest.raises(ValueError, match="SESSION_SEQUENCES"):
        transform(df, "sessions")


def test_profile_constant_target(spark):
    df = spark.createDataFrame([("u0", f"i{i}", 1.0) for i in range(5)], "USER_ID string, ITEM_ID string, OUTCOME double")
    p = pf.profile_interactions(df).first()
    assert p["target_type"] == "constant"
    assert p["duplicate_pairs"] == 0


def test_classify_rating_and_categorical(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (3, "a")], "stars long, cat string")
    assert pf.classify_target(df, "stars").first()["target_type"] == "rating"
    assert pf.classify_target(df, "cat").first()["target_type"] == "categorical"


def test_validate_wrong_names(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "userid string, itemid string, clicked double")
    r = vd.validate_schema(df, "interactions")
    assert r["missing_columns"] == ["USER_ID", "ITEM_ID", "OUTCOME"]
    assert r["suggested_column_mapping"].get("userid") == "USER_ID"
    assert not r["valid"]


def test_overlap_guard(spark):
    inter = spark.createDataFrame([("a", "x", 1.0)], "USER_ID string, ITEM_ID string, OUTCOME double")
    users = spark.createDataFrame([("z", 1)], "USER_ID string, age long")
    with pytest.raises(vd.ContractViolation, match="share no"):
        vd.check_user_overlap(inter, users)
    vd.check_user_overlap(inter, spark.createDataFrame([("a", 1)], "USER_ID string, age long"))
    assert rows(vd.user_overlap(inter, users)) == [(1, 1, 0)]


def test_binary_rewards(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,), (3.0,), (2.0,)], "REWARD double")
    r = vd.binary_reward_report(df).first()
    assert r["n_bad"] == 2 and r["samples"] == [2.0, 3.0]


def test_bundle_refuses_item_features_on_wide(spark):
    wide = spark.createDataFrame([("a", 1.0, 0.0)], "USER_ID string, ITEM_x double, ITEM_y double")
    items = spark.createDataFrame([("x", 1)], "ITEM_ID string, f long")
    with pytest.raises(vd.ContractViolation):
        bd.create_bundle(wide, items=items)


def test_bundle_merges_users_into_wide(spark):
    wide = spark.createDataFrame([("a", 1.0, 0.0)], "USER_ID string, ITEM_x double, ITEM_y double")
    users = spark.createDataFrame([("a", 5)], "USER_ID string, age long")
    b = bd.create_bundle(wide, users=users)
    assert "age" in b.interactions.columns and b.dataset_type == "interaction_multioutput"


def test_resplit_makes_a_new_bundle_version(spark):
    from pyspark.sql import functions as F
    from ranklab.operators import split as sp
    inter = spark.createDataFrame([("u1", f"i{i}", float(i % 2), i) for i in range(10)],
                                  "USER_ID string, ITEM_ID string, OUTCOME double, TIMESTAMP long")
    b = bd.create_bundle(inter)
    b2 = b.with_splits(sp.temporal_split(inter, 0.2, 0.2, "TIMESTAMP", ["ITEM_ID"]))
    assert b2.version != b.version and b.valid is None
    assert (b2.interactions.count(), b2.valid.count(), b2.test.count()) == (6, 2, 2)
    assert "split" not in b2.valid.columns and b2.test.agg(F.min("TIMESTAMP")).first()[0] == 8


@pytest.mark.parametrize("profile,strategy", [
    ({"has_timestamps": True}, "temporal"), ({"sequential": True}, "leave_last_n_per_user"),
    ({"cold_start": True}, "leave_n_users_out"), ({}, "random_split_per_user")])
def test_split_recommendation(profile, strategy):
    from ranklab.operators import split as sp
    assert sp.recommend_strategy(profile) == strategy
