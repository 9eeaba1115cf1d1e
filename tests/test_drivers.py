import os
import tempfile

import pytest

from ranklab.operators import diagnose as dg
from ranklab.plans import evaluate as ev
from ranklab.sources import ingest
from ranklab.streaming.ingest import start_ingest


def test_failure_classification(spark):
    log = spark.createDataFrame([
        ("m1", 1, "TargetError", "fewer than 2 surviving targets after dropping single-class ones"),
        ("m2", 2, "Py4JJavaError", "java.lang.OutOfMemoryError: Java heap space"),
        ("m3", 3, "ModuleNotFoundError", "No module named 'torch'"),
        ("m4", 4, "ValueError", "No module named 'x' in text but wrong type"),
        ("m5", 5, "RuntimeError", "something else entirely"),
    ], "model_id string, ts long, error_type string, message string")
    got = {r["model_id"]: r["category"] for r in dg.classify_failures(log).collect()}
    assert got == {"m1": "single_class_target", "m2": "oom", "m3": "missing_dependency", "m4": "unknown",
                   "m5": "unknown"}
    d = {r["model_id"]: r for r in dg.diagnose(log).collect()}
    assert d["m2"]["fixes"][0]["rank"] == 1 and d["m5"]["fixes"] is None
    assert dg.category_counts(log).first()["category"] == "unknown"


def test_evaluator_metric_guards():
    with pytest.raises(ev.EvaluatorMetricMismatch):
        ev.check_request("IPS", ["rmse"])
    with pytest.raises(ev.EvaluatorMetricMismatch):
        ev.check_request("DR", ["roc_auc"])
    ev.check_request("replay_match", ["roc_auc"])
    with pytest.raises(ValueError):
        ev.check_request("simple", ["NDCG_at_k"], "wide_multioutput", per_label=True)
    with pytest.raises(ValueError, match="scorer_config"):
        ev.check_scorer_config("universal", {"on_degenerate_target": "constant"})
    ev.check_scorer_config("multioutput", {"on_degenerate_target": "constant"})


def test_evaluate_driver(spark):
    logged = spark.createDataFrame([("r1", "u1", "a", 1.0), ("r2", "u2", "b", 0.0), ("r3", "u2", "c", 1.0)],
                                   "INSTANCE string, USER_ID string, ITEM_ID string, REWARD double")
    topk = spark.createDataFrame([("a", 1), ("c", 2)], "ITEM_ID string, rank long")
    pairs = spark.createDataFrame([("u1", "a", 0.9), ("u2", "b", 0.1), ("u2", "c", 0.8)],
                                  "USER_ID string, ITEM_ID string, score double")
    res = ev.evaluate("pop", ev.Scores(topk=topk, pair_scores=pairs), logged,
                      metrics=["precision_at_k", "roc_auc", "rmse"], k_values=[1, 2], single_item_instances=True)
    got = {(r["metric"], r["k"]): r["value"] for r in res.collect()}
    assert got[("precision", 1)] == pytest.approx(1 / 3) and got[("roc_auc", None)] == 1.0


def test_validation_fallback(spark):
    train = spark.createDataFrame([(1,)], "x long")
    empty = spark.createDataFrame([], "x long")
    assert ev.pick_eval_frame(empty, train)[1] == "train"
    assert ev.pick_eval_frame(train, train)[1] == "valid"


def test_read_write_guards(spark):
    with pytest.raises(ingest.SourceNotFound):
        ingest.read_table(spark, "/nonexistent/path.parquet")
    d = tempfile.mkdtemp(prefix="ranklab-io-")
    df = spark.createDataFrame([(1, 2, 1.0, "train"), (3, 4, 0.0, "valid")],
                               "userid long, itemid long, rating double, split string")
    csv = os.path.join(d, "in.csv")
    df.drop("split").coalesce(1).write.option("header", "true").csv(csv)
    back = ingest.read_interactions(spark, csv, {"userid": "USER_ID", "itemid": "ITEM_ID"}, fmt="csv")
    assert dict(back.dtypes)["USER_ID"] == "string" and back.count() == 2
    with pytest.raises(ingest.InPlaceWrite):
        ingest.write_table(back, csv, source_paths=[csv])
    out = os.path.join(d, "splits")
    ingest.write_splits(df, out)
    assert {"split=train", "split=valid"} <= set(os.listdir(out))


def test_streaming_ingest(spark):
    d = tempfile.mkdtemp(prefix="ranklab-stream-")
    src, sink = os.path.join(d, "in"), os.path.join(d, "out")
    df = spark.createDataFrame([(1, 10, 1, "2024-01-01 00:00:00")], "uid long, iid long, rew long, ts string")
    df.write.parquet(os.path.join(src, "batch1"))
    schema = df.schema
    q = start_ingest(spark, os.path.join(src, "*"), schema, sink,
                     {"uid": "USER_ID", "iid": "ITEM_ID", "rew": "OUTCOME", "ts": "TIMESTAMP"},
                     checkpoint_dir=os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    r = out.first()
    assert r["USER_ID"] == "1" and r["OUTCOME"] == 1.0 and r["TIMESTAMP"] == 1704067200


def test_streaming_ingest_resumes_exactly_once(spark):
    d = tempfile.mkdtemp(prefix="ranklab-stream2-")
    src, sink, ckpt = os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ckpt")
    schema = "uid long, iid long, rew long, ts string"
    mapping = {"uid": "USER_ID", "iid": "ITEM_ID", "rew": "OUTCOME", "ts": "TIMESTAMP"}
    spark.createDataFrame([(1, 10, 1, "2024-01-01 00:00:00")], schema).write.parquet(os.path.join(src, "b1"))
    first = spark.createDataFrame([], schema).schema
    start_ingest(spark, os.path.join(src, "*"), first, sink, mapping, checkpoint_dir=ckpt).awaitTermination(120)
    spark.createDataFrame([(2, 20, 0, "2024-01-02 00:00:00")], schema).write.parquet(os.path.join(src, "b2"))
    start_ingest(spark, os.path.join(src, "*"), first, sink, mapping, checkpoint_dir=ckpt).awaitTermination(120)
    got = sorted(r["USER_ID"] for r in spark.read.parquet(sink).collect())
    assert got == ["1", "2"]  # the restarted job appended only the new file


@pytest.mark.parametrize("error_type,message,category", [
    ("TargetError", "ITEM_x is single-class in train", "single_class_target"),
    ("ContractViolation", "REWARD must be binary 0/1; 3 rows are not", "non_binary_target"),
    ("ContractViolation", "interactions and users share no USER_ID", "user_id_overlap_zero"),
    ("ValueError", "pass per_label=True (one row per target)", "missing_decision"),
    ("ValueError", "recommender 'bandits' does not accept scorer 'multiclass'", "capability_mismatch"),
    ("EvaluatorMetricMismatch", "metrics ['rmse'] only compose with evaluator 'simple'", "evaluator_metric_mismatch"),
    ("ValueError", "off-policy evaluation needs columns ['PROPENSITY']", "evaluator_needs_eval_kwargs"),
    ("ContractViolation", "long_interactions: missing required columns ['OUTCOME']", "schema_mismatch"),
    ("ValueError", "wide_multioutput needs at least 2 targets, found []", "wide_multioutput_underspecified"),
    ("Py4JJavaError", "java.lang.OutOfMemoryError: GC overhead limit exceeded", "oom"),
    ("Py4JJavaError", "ExecutorLostFailure (executor 7 exited)", "executor_lost"),
    ("RuntimeError", "loss is NaN after 3 iterations", "numerical_instability"),
    ("ModuleNotFoundError", "No module named 'xgboost'", "missing_dependency"),
    ("TimestampParseError", "2 value(s) in 'date' could not be parsed as timestamps", "timestamp_parse"),
    ("DegenerateSplit", "validation split is empty ({'train': 20})", "degenerate_split"),
    ("TimeoutError", "fit timed out", "timeout"),
    ("KeyError", "'something odd'", "unknown"),
])
def test_failure_registry_patterns(spark, error_type, message, category):
    log = spark.createDataFrame([("m", 1, error_type, message)], "model_id string, ts long, error_type string, message string")
    assert dg.classify_failures(log).first()["category"] == category


def _logged(spark):
    logged = spark.createDataFrame([(str(i), f"u{i % 3}", f"i{i % 4}", float(i % 2), 0.25) for i in range(40)],
                                   "INSTANCE string, USER_ID string, ITEM_ID string, REWARD double, PROPENSITY double")
    items = spark.createDataFrame([(f"i{j}", 0.1 * j) for j in range(4)], "ITEM_ID string, score double")
    return logged, items, spark.createDataFrame([("i3", 1), ("i2", 2)], "ITEM_ID string, rank long")


@pytest.mark.parametrize("evaluator", ["replay_match", "IPS", "SNIPS", "policy_weighted", "direct_method", "DR"])
def test_off_policy_driver_answers_each_metric_at_each_k(spark, evaluator):
    from ranklab.operators import offpolicy as op
    logged, items, topk = _logged(spark)
    res = ev.evaluate("pop", ev.Scores(topk=topk, item_scores=items), logged, evaluator=evaluator,
                      metrics=["average_reward_at_k", "NDCG_at_k", "expected_reward"], k_values=[1, 2], epsilon=0.2).collect()
    got = {(r["metric"], r["k"]): r["value"] for r in res}
    assert set(got) == {(m, k) for m in ("average_reward", "ndcg") for k in (1, 2)} | {("expected_reward", None)}
    want = {r["metric"]: r["value"] for r in op.off_policy_estimates(
        logged, items.withColumnRenamed("score", "q"), 0.2, top1=topk.filter("rank = 1")).collect()}
    if evaluator != "replay_match":
        assert got["expected_reward", None] == pytest.approx(want[evaluator])
    rank, q, n = {"i3": 1, "i2": 2}, {f"i{j}": .1 * j for j in range(4)}, 4
    rows = [(r["ITEM_ID"], r["REWARD"], r["PROPENSITY"]) for r in logged.collect()]
    k = 2
    gain = {i: (1 / k if evaluator else 0) for i in rank}

    def m(i, v):
        return gain[i] * v if i in rank else 0.0

    def pi(i):
        return (0.8 / k if i in rank else 0) + 0.2 / n
    dm = sum(pi(i) * gain[i] * q[i] for i in rank)
    by_hand = {
        "replay_match": sum(m(i, r) for i, r, _ in rows if i in rank) / sum(i in rank for i, _, _ in rows),
        "IPS": sum(pi(i) / p * m(i, r) for i, r, p in rows) / 40,
        "SNIPS": sum(pi(i) / p * m(i, r) for i, r, p in rows) / sum(pi(i) / p for i, _, p in rows),
        "policy_weighted": sum(pi(i) * m(i, r) for i, r, _ in rows) / sum(pi(i) for i, _, _ in rows),
        "direct_method": dm, "DR": dm + sum(pi(i) / p * (m(i, r) - m(i, q[i])) for i, r, p in rows) / 40}
    assert got["average_reward", 2] == pytest.approx(by_hand[evaluator])


def test_off_policy_with_scores_per_user(spark):
    logged, _, _ = _logged(spark)
    pairs = spark.createDataFrame([(f"u{u}", f"i{i}", .1 * i + .2 * u) for u in range(3) for i in range(4)], "USER_ID string, ITEM_ID string, score double")
    topk = spark.createDataFrame([(f"u{u}", f"i{u}", 1) for u in range(3)], "USER_ID string, ITEM_ID string, rank long")
    res = ev.evaluate("m", ev.Scores(topk=topk, pair_scores=pairs), logged, "direct_method", ["expected_reward", "precision_at_k"], [1], epsilon=0.0).collect()
    share = [sum(i % 3 == u for i in range(40)) / 40 for u in range(3)]
    want = sum(share[u] * (.1 * u + .2 * u) for u in range(3))
    assert {r["metric"]: pytest.approx(r["value"]) for r in res} == {"expected_reward": want, "precision": want}


def test_requests_are_answered_or_refused(spark):
    logged, items, topk = _logged(spark)
    bare = logged.drop("PROPENSITY")
    sc = ev.Scores(topk=topk, item_scores=items)
    assert ev.evaluate("m", sc, bare, "replay_match", ["precision_at_k"], [1]).count() == 1
    auc = ev.evaluate("m", sc, bare, "replay_match", ["roc_auc"]).collect()
    assert [(r["metric"], r["value"]) for r in auc] == [("roc_auc", None)]     # one item, one class: i3 always pays
    for evaluator, scores, frame, metric in (("IPS", sc, bare, "precision_at_k"), ("DR", ev.Scores(topk=topk), logged, "precision_at_k"),
                                             ("simple", ev.Scores(topk=topk), logged, "expected_reward"), ("simple", ev.Scores(), logged, "recall_at_k"),
                                             ("simple", ev.Scores(topk=topk), logged, "rmse")):
        with pytest.raises(ValueError):
            ev.evaluate("m", scores, frame, evaluator, [metric], [1])
    with pytest.raises(ValueError):
        ev.evaluate("m", sc)


def test_a_deeper_list_is_not_served_from_the_cache(spark):
    logged, items, topk = _logged(spark)
    with ev.ScoreCache() as cache:
        values = [ev.evaluate("m", ev.Scores(topk=topk.filter(f"rank <= {d}")), logged, metrics=["recall_at_k"], k_values=[5],
                              single_item_instances=True, cache=cache).first()["value"] for d in (1, 2)]
        assert values == [0.5, 0.5] or values[1] >= values[0]
        assert len(cache._held) == 2
    assert not cache._held


def test_repeated_items_keep_metrics_in_bounds(spark):
    from ranklab.operators import metrics as mt
    logged = spark.createDataFrame([("u", "u", "a", 1.0)] * 12 + [("u", "u", "b", 0.0)], "INSTANCE string, USER_ID string, ITEM_ID string, REWARD double")
    top = spark.createDataFrame([("a", 1), ("b", 2)], "ITEM_ID string, rank long")
    got = {r["metric"]: r["value"] for r in mt.ranking_metrics(logged, top, [10]).collect()}
    assert got == {"precision": 0.1, "recall": 1.0, "map": 1.0, "ndcg": 1.0, "mrr": 1.0}


def test_sql_and_json_sources(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").createOrReplaceTempView("ranklab_src")
    assert ingest.from_sql(spark, "SELECT count(*) AS n FROM ranklab_src").first()["n"] == 2
    d = tempfile.mkdtemp(prefix="ranklab-json-")
    spark.createDataFrame([(1, "a")], "id long, v string").write.json(os.path.join(d, "j"))
    back = ingest.read_table(spark, os.path.join(d, "j"), fmt="json", schema="id long, v string")
    assert back.collect()[0]["v"] == "a"
