import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ranklab.operators import audit as au
from ranklab.operators import split as sp
from ranklab.plans import evaluate as ev
from ranklab.plans.bundle import create_bundle
from ranklab.plans.drive import evaluate_trained, sweep_bundle
from ranklab.plans.train import train
from ranklab.sources import registry as rg

SMALL = {"n_estimators": 2, "max_depth": 2}


@pytest.fixture(scope="module")
def bundle(spark):
    data = [(f"u{u}", f"i{(u * k + k) % 9}", float((u + k) % 3 == 0), u * 100 + k) for u in range(40) for k in range(8)]
    rows = spark.createDataFrame(data, "USER_ID string, ITEM_ID string, OUTCOME double, TIMESTAMP long")
    users = spark.createDataFrame([(f"u{u}", float(u % 5)) for u in range(40)], "USER_ID string, age double")
    return create_bundle(rows, users=users).with_splits(sp.split(rows, "temporal", valid_fraction=.2, test_fraction=.1))


def test_sweep_over_a_bundle(spark, bundle):
    root = tempfile.mkdtemp(prefix="ranklab-sweep-")
    request = [{"short_name": "gbt", "params": SMALL}, {"short_name": "als", "estimator": "als", "estimator_type": "embedding", "params": {"n_factors": 4, "epochs": 2}},
               "markov_sequential", {"short_name": "broken", "estimator": "nothing"}]
    kw = dict(primary_metric="recall_at_3", metrics=["recall_at_k", "NDCG_at_k"], k_values=[1, 3], keep_top_k=4, bundle_id="b",
              models_root=f"{root}/models", failures_path=f"{root}/failures", results_path=f"{root}/results")
    out = sweep_bundle(bundle, request, **kw)
    assert out["scored_slice"] == "valid" and [r["status"] for r in out["rows"]] == ["ok", "ok", "ok", "error"]
    values = [r["metrics"]["recall@3"] for r in out["rows"][:3]]
    assert values == sorted(values, reverse=True) and set(out["rows"][0]["metrics"]) == {"recall@1", "recall@3", "ndcg@1", "ndcg@3"}
    assert sorted(r["name"] for r in rg.list_models(spark, f"{root}/models").collect()) == ["als", "gbt", "markov_sequential"]
    loaded, _ = rg.load_model(spark, f"{root}/models", "als")
    assert set(loaded.extras) == {"umap", "imap"} and os.path.isdir(f"{root}/failures")
    assert au.last_failure_per_model(spark.read.parquet(f"{root}/failures")).first()["model_id"] == "broken"
    with pytest.raises(RuntimeError):   # the finished three are not run again; the broken one is
        sweep_bundle(bundle, request, **kw)


def test_guards_and_advice(spark, bundle):
    with pytest.raises(ValueError, match="does not accept"):
        sweep_bundle(bundle, {"recommender_type": "bandits", "scorer_type": "multiclass"})
    with pytest.raises(ValueError, match="per_label"):
        sweep_bundle(bundle, metrics=["roc_auc"], per_label=None)
    out = sweep_bundle(bundle, "auto", "roc_auc", ["roc_auc"], advised=True)
    assert [r["model_id"] for r in out["rows"]] == ["gbt_universal_tiny"] and len(out["dropped"]) == 3


def test_sequences(spark, bundle):
    s = bundle.interactions.groupBy("USER_ID").agg(F.transform(F.array_sort(F.collect_list(F.struct("TIMESTAMP", "ITEM_ID"))), lambda x: x["ITEM_ID"]).alias("ITEM_SEQUENCE"))
    root = tempfile.mkdtemp(prefix="ranklab-sweep-")
    out = sweep_bundle(create_bundle(s), k_values=[2], primary_metric="recall@2", keep_top_k=1, models_root=root)
    assert out["scored_slice"] == "train" and 0 <= out["rows"][0]["metrics"]["recall@2"] <= 1
    assert [r["kind"] for r in rg.list_models(spark, root).collect()] == ["transitions"]
    b = create_bundle(s)
    with pytest.raises(ValueError, match="no scores for roc_auc"):      # refused, not dropped
        evaluate_trained(train(b), b.interactions, b.contract, ["recall_at_k", "roc_auc"], [2])


def test_evaluate_guards(spark):
    logged = spark.createDataFrame([("1", "u", "i", 3.0)], "INSTANCE string, USER_ID string, ITEM_ID string, REWARD double")
    top = spark.createDataFrame([("i", 1)], "ITEM_ID string, rank long")
    with pytest.raises(ValueError, match="binary"):
        ev.evaluate("m", ev.Scores(topk=top), logged, metrics=["recall_at_k"], binary_rewards=True)
    with pytest.raises(ValueError, match="per_label"):
        ev.evaluate("m", ev.Scores(topk=top, item_scores=top), logged, metrics=["roc_auc"], per_label=None)
