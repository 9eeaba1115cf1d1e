import os
import tempfile

import pytest

from ranklab.functions import names
from ranklab.operators import audit as au
from ranklab.operators import leaderboard as lb
from ranklab.plans import methods as me
from ranklab.plans import sweep as sw
from ranklab.sources import registry as rg


def _profile(spark, **kw):
    full = {"n_rows": None, "sparsity": None, "target_type": "binary", "has_timestamps": None, **kw}
    return spark.createDataFrame([tuple(full.values())], "n_rows long, sparsity double, target_type string, has_timestamps boolean")


def _advice(spark, contract, **profile):
    methods = me.AUTO_SWEEPS[contract]
    rows = me.advice(me.as_table(spark, methods), _profile(spark, **profile))
    return {r["short_name"]: r for r in rows.collect()}, me.apply_advice(methods, rows)


@pytest.mark.parametrize("n,tier", [(100, "tiny"), (4_999, "tiny"), (5_000, "small"), (50_000, "small"), (500_000, "medium"), (5_000_000, "large")])
def test_tiers(spark, n, tier):
    rows, _ = _advice(spark, "long_multi_reward", n_rows=n)
    assert rows["gbt_universal"]["tier"] == tier and rows["gbt_universal"]["sized_name"] == f"gbt_universal_{tier}"


def test_tiny_profile_drops_embedding_methods(spark):
    _, (kept, dropped) = _advice(spark, "long_with_timestamp", n_rows=500, sparsity=0.99, has_timestamps=True)
    assert [m["short_name"] for m in kept] == ["gbt_universal_tiny"]
    assert len(dropped) == 3 and all(d["reason"] for d in dropped)


@pytest.mark.parametrize("sparsity,keep", [(0.99, True), (0.90, True), (0.5, False)])
def test_sparsity_decides_on_als(spark, sparsity, keep):
    rows, _ = _advice(spark, "long_interactions", n_rows=50_000, sparsity=sparsity)
    assert rows["als_universal"]["kept"] == keep
    assert keep or "sparsity" in rows["als_universal"]["reason"]


def test_continuous_swaps_to_regression(spark):
    _, (kept, _) = _advice(spark, "long_multi_reward", n_rows=200, target_type="continuous")
    assert kept[0]["task"] == "regression" and kept[0]["params"]["n_estimators"] == 30 and kept[0]["params"]["learning_rate"] == 0.1
    rows, _ = _advice(spark, "wide_multioutput", n_rows=9_000, target_type="continuous")
    assert [r["kept"] for r in rows.values()] == [False, True]


def test_capability(spark):
    t = spark.createDataFrame([("a", "ranking", "universal", "embedding"), ("b", "bandits", "multiclass", "tabular"),
                               ("c", "ranking", "independent", "embedding"), ("d", "nobody", "universal", "tabular")],
                              "short_name string, recommender_type string, scorer_type string, estimator_type string")
    assert [r["short_name"] for r in me.compatible(t).collect()] == ["a"]
    why = {r["short_name"]: r["reason"] for r in me.incompatible(t).collect()}
    assert set(why) == {"b", "c", "d"} and "'multiclass'" in why["b"] and "family 'embedding'" in why["c"] and "'nobody'" in why["d"]


def test_broad_and_resolve(spark):
    names = [m["short_name"] for m in me.resolve("long_interactions", "broad", spark=spark)]
    assert names == sorted(f"{r}_{s}_tabular" for r in ("ranking", "bandits", "uplift", "gcsl") for s in ("universal", "independent"))
    uplift = next(m for m in me.resolve("long_interactions", "broad", spark=spark) if m["recommender_type"] == "uplift")
    assert uplift["params"]["control_item_id"] == "control"
    assert len(me.resolve("wide_multioutput", "broad", spark=spark)) == 5
    assert me.resolve("long_interactions", {"estimator": "fm", "estimator_type": "embedding"})[0]["estimator"] == "fm"
    for bad in ("nothing", "all"):
        with pytest.raises(ValueError):
            me.resolve("long_interactions", bad)
    assert me.menu(spark, "long_interactions").count() == 3


def test_config_hash_ignores_short_name():
    a = {"short_name": "x", "estimator": "gbt", "params": {"a": 1}}
    b = {"short_name": "y", "params": {"a": 1}, "estimator": "gbt"}
    assert sw.config_hash("b1", a) == sw.config_hash("b1", b) != sw.config_hash("b2", a)


@pytest.mark.parametrize("spec,want", [("NDCG@10", ("NDCG", 10)), ("NDCG_at_10", ("NDCG_at_k", 10)),
                                       ("NDCG_at_k", ("NDCG_at_k", 10)), ("roc_auc", ("roc_auc", 10))])
def test_metric_spec(spec, want):
    assert lb.split_metric_spec(spec, 10) == want


def test_metric_spec_columns(spark):
    df = spark.createDataFrame([("NDCG@5",), ("NDCG_at_10",), ("roc_auc",)], "s string")
    name, k = lb.metric_spec_columns(df.s)
    got = [(r[0], r[1]) for r in df.select(name, k).collect()]
    assert got == [("NDCG", 5), ("NDCG_at_k", 10), ("roc_auc", 10)]


def test_direction():
    assert not lb.higher_is_better("rmse") and lb.higher_is_better("NDCG@10")


def test_sweep_is_idempotent_and_isolates_failures():
    calls = []

    def fit_eval(m):
        calls.append(m["short_name"])
        if m["short_name"] == "bad":
            raise RuntimeError("boom")
        return {"ndcg@10": {"a": 0.2, "b": 0.5}[m["short_name"]]}

    methods = [{"short_name": n, "estimator": "gbt", "params": {"tag": n}} for n in ("a", "b", "bad")]
    cache = {}
    rows = sw.sweep(methods, fit_eval, "bundle1", cache=cache, keep_top_k=1)
    assert [r["model_id"] for r in rows] == ["b", "a", "bad"] and rows[0]["keep"] and not rows[1]["keep"]
    calls.clear()
    rows = sw.sweep(methods, fit_eval, "bundle1", cache=cache)
    assert calls == ["bad"] and {r["status"] for r in rows} == {"cached", "error"}


@pytest.mark.parametrize("spelling", ["NDCG_at_10", "NDCG_at_k@10", "ndcg@10", "NDCG@10", "ndcg_10"])
def test_sweep_ranks_by_value_in_any_spelling(spelling):
    score = {"a": 0.1, "z": 0.9}
    methods = [{"short_name": n, "params": {"tag": n}} for n in score]
    rows = sw.sweep(methods, lambda m: {"ndcg@10": score[m["short_name"]], "expected_reward": -score[m["short_name"]]}, "b", spelling)
    assert [r["model_id"] for r in rows] == ["z", "a"]
    rows = sw.sweep(methods, lambda m: {"expected_reward": score[m["short_name"]]}, "b", "expected_reward")
    assert [r["model_id"] for r in rows] == ["z", "a"]
    rows = sw.sweep(methods, lambda m: {"rmse": score[m["short_name"]]}, "b", "rmse")
    assert [r["model_id"] for r in rows] == ["a", "z"]
    with pytest.raises(ValueError, match="primary metric"):
        sw.sweep(methods, lambda m: {"rmse": 1.0}, "b", spelling)


def test_sweep_failures_are_classified_recorded_and_winners_kept(spark):
    kept, freed = [], []

    def fit_eval(m):
        if m["short_name"] == "bad":
            raise ValueError("REWARD must be binary 0/1; 3 rows are not")
        return {"roc_auc": {"a": .5, "b": .7}[m["short_name"]]}, m["short_name"]

    methods = [{"short_name": n, "params": {"tag": n}} for n in ("a", "b", "bad")]
    rows = sw.sweep(methods, fit_eval, "x", "roc_auc", keep_top_k=1, save=lambda r, m: kept.append(m), release=lambda r, m: freed.append(m))
    assert kept == ["b"] and freed == ["a"] and rows[2]["category"] == "non_binary_target"
    path = os.path.join(tempfile.mkdtemp(prefix="ranklab-failures-"), "f")
    sw.record_failures(spark, rows, path)
    sw.record_failures(spark, rows, path)
    log = spark.read.parquet(path)
    assert sw.dominant_failure(log) == "non_binary_target"
    assert au.last_failure_per_model(log).first()["message"].startswith("REWARD")
    assert au.retries_per_model(log).first()["retry_allowed"]
    with pytest.raises(RuntimeError, match="non_binary_target"):
        sw.sweep(methods[2:], fit_eval, "x", "roc_auc")


def test_trials_cover_the_grid_and_every_axis():
    space = {f"a{i:02d}": ("float", 0.0, 1.0, {}) for i in range(14)}
    pts = sw.trial_table(space, 16, "qmc")
    axes = [tuple(p[n] for p in pts) for n in sorted(space)]
    assert len(set(axes)) == 14
    full = sw.trial_table(sw.SEARCH_SPACES["gbt"], 0, "grid")
    assert len(full) == 27 and len({t["learning_rate"] for t in full}) == 3
    with pytest.raises(ValueError, match="27"):
        sw.trial_table(sw.SEARCH_SPACES["gbt"], 8, "grid")
    with pytest.raises(ValueError, match="validation"):
        sw.search({"short_name": "m"}, {}, None, has_validation=False)
    best = sw.search({"short_name": "m", "params": {}}, {"x": ("int", 0, 9, {})}, lambda m: {"rmse": m["params"]["x"]}, metric="rmse", retrain=lambda m: m["params"])
    assert best[0]["value"] == min(t["value"] for t in best) and best[0]["model"] == best[0]["params"]


def test_trials_are_deterministic():
    space = sw.SEARCH_SPACES["gbt"]
    assert sw.trial_table(space, 5, "random", 1) == sw.trial_table(space, 5, "random", 1)
    assert len(sw.trial_table({"a": ("int", 1, 3, {}), "b": ("categorical", ["x", "y"], None, {})}, 0, "grid")) == 6
    for t in sw.trial_table(space, 8, "qmc"):
        assert 20 <= t["n_estimators"] <= 300 and 0.01 <= t["learning_rate"] <= 0.3


def test_name_detection():
    d = names.detect_id_columns(["userid", "movieid", "clicked", "timestamp"])
    assert d == {"user_id": "userid", "item_id": "movieid"}
    assert names.detect_target_column(["userid", "clicked"]) == "clicked"
    assert names.detect_timestamp_column(["userid", "timestamp"]) == "timestamp"


def _conv(spark, msgs):
    return spark.createDataFrame([(1, i, role, text) for i, (role, text) in enumerate(msgs)],
                                 "conv_id long, turn long, role string, text string")


def test_url_audit(spark):
    got = lambda msgs: sorted(r["url"] for r in au.novel_urls(_conv(spark, msgs)).collect())
    assert got([("user", "hi"), ("assistant", "see https://www.kaggle.com/data")]) == ["https://www.kaggle.com/data"]
    assert got([("user", "use https://a.org/x"), ("assistant", "ok https://a.org/x")]) == []
    assert got([("user", "use https://a.org/x"), ("assistant", "https://a.org/x and https://b.org/y")]) == \
        ["https://b.org/y"]
    assert got([("user", "(https://a.org/x)."), ("assistant", "see (https://a.org/x).")]) == []


def test_foreign_packages(spark):
    text = "look:\n```python\nimport torch\nimport os\nfrom ranklab import x\ndf = pd.read_csv('f')\n```\n"
    got = sorted(r["package"] for r in au.foreign_references(_conv(spark, [("assistant", text)])).collect())
    assert got == ["pandas", "torch"]


def test_model_registry_roundtrip(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df)
    root = tempfile.mkdtemp(prefix="ranklab-models-")
    rg.save_model(spark, root, "m1", model, "pipeline", {"recommender_type": "ranking"}, {"ndcg@10": 0.1},
                  tags=["x", "y", "x"])
    with pytest.raises(rg.RegistryError):
        rg.save_model(spark, root, "m1", model, "pipeline")
    listed = rg.list_models(spark, root, tag_filter=["x"]).collect()
    assert [r["name"] for r in listed] == ["m1"] and listed[0]["tags"] == ["x", "y"]
    assert rg.list_models(spark, root, tag_filter=["z"]).count() == 0
    loaded, meta = rg.load_model(spark, root, "m1")
    assert meta["kind"] == "pipeline" and loaded.transform(df).count() == 1
    with pytest.raises(rg.RegistryError):
        rg.validate_model_name("../etc")
    assert os.path.isdir(os.path.join(root, "m1", "model"))


def test_search_ranks_saves_and_picks_best(spark):
    base = {"short_name": "m", "estimator": "gbt", "params": {"x": 0}}
    space = {"x": ("int", 0, 10, {})}
    trials = sw.search(base, space, lambda m: {"score": -abs(m["params"]["x"] - 7)}, n_trials=6,
                       sampler="random", metric="score", seed=3)
    values = [t["value"] for t in trials]
    assert values == sorted(values, reverse=True)
    best = sw.best_method(base, trials)
    assert best["params"]["x"] == trials[0]["params"]["x"] and best["short_name"] == "m_best"
    saved = sw.save_trials(spark, trials, os.path.join(tempfile.mkdtemp(prefix="ranklab-trials-"), "t"))
    assert saved.count() == 6 and saved.orderBy("position").first()["trial"] == trials[0]["trial"]


def test_persistent_results_table_skips_done_methods(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ranklab-results-"), "results")
    methods = [{"short_name": n, "estimator": "gbt", "params": {"tag": n}} for n in ("a", "b", "c")]
    assert len(sw.pending_methods(spark, methods, "b1", path)) == 3
    rows = sw.sweep(methods[:2], lambda m: {"ndcg@10": 0.1} if m["short_name"] == "a" else {}, "b1")
    sw.record_results(spark, rows, "b1", path)
    left = sorted(m["short_name"] for m in sw.pending_methods(spark, methods, "b1", path))
    assert left == ["b", "c"]  # 'b' had empty metrics -> re-evaluated
    assert len(sw.pending_methods(spark, methods, "other_bundle", path)) == 3


def test_url_audit_scoping(spark):
    rows = [(1, 0, "user", "see https://a.org/x"), (2, 0, "user", "hi"), (2, 1, "assistant", "try https://a.org/x"),
            (3, 0, "assistant", "go to https://b.org/y"), (3, 1, "user", "thanks for https://b.org/y")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["url"]) for r in au.novel_urls(conv).collect())
    # conv 2: the user URL from conv 1 does not count; conv 3: the user typed it only after the assistant
    assert got == [(2, "https://a.org/x"), (3, "https://b.org/y")]
    counts = {r["conv_id"]: (r["n_urls"], r["n_novel_urls"]) for r in au.novel_url_counts(conv).collect()}
    assert counts == {1: (1, 0), 2: (1, 1), 3: (2, 1)}


def test_leaderboard_direction_and_missing_last(spark):
    res = spark.createDataFrame([("a", "rmse", None, 2.0), ("b", "rmse", None, 1.0), ("c", "ndcg", 10, 0.3),
                                 ("a", "ndcg", 10, 0.5)], "model_id string, metric string, k long, value double")
    board = lb.leaderboard(res, "rmse").collect()
    assert [r["model_id"] for r in board] == ["b", "a", "c"]  # ascending loss, model without rmse last
    board = lb.leaderboard(res, "NDCG@10").collect()
    assert [r["model_id"] for r in board] == ["a", "c", "b"]
    rows = spark.createDataFrame([("x", "ok", 0.2), ("y", "error", None), ("z", "cached", 0.4), ("w", "ok", None)],
                                 "model_id string, status string, m double")
    order = lb.sweep_order(rows, "m").orderBy("position").collect()
    assert [r["model_id"] for r in order] == ["z", "x", "w", "y"] and order[0]["is_winner"]
