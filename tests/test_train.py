"""The train driver returns a scoring handle for each trainable contract."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ranklab.plans import evaluate as ev
from ranklab.plans import methods as me
from ranklab.plans.bundle import create_bundle
from ranklab.plans.train import load_trained, save_trained, train
from ranklab.sources import registry as rg


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"u{u}", f"i{(u + k) % 8}", float((u + k) % 3 == 0), u * 100 + k, float(k % 4) * 10) for u in range(30) for k in range(8)]
    return spark.createDataFrame(data, "USER_ID string, ITEM_ID string, OUTCOME double, TIMESTAMP long, OUTCOME_rev double")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(f"u{u}", float(u % 5), "ab"[u % 2]) for u in range(30)], "USER_ID string, age double, segment string")


SMALL = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1}


def check(handle, frame, contract, metrics, k=3):
    out = ev.evaluate(handle.model_id, handle.scores(frame, k), metrics=metrics, k_values=[k], contract=contract, frame=frame,
                      scorer_type=handle.config["scorer_type"]).collect()
    assert len(out) == len(metrics) and all(r["value"] is not None for r in out)
    assert handle.train_seconds > 0


@pytest.mark.parametrize("method", [
    {"short_name": "gbt", "params": SMALL}, {"short_name": "als", "estimator": "als", "estimator_type": "embedding", "params": {"n_factors": 4, "epochs": 2}},
    {"short_name": "ind", "scorer_type": "independent"}, {"short_name": "up", "recommender_type": "uplift", "params": {"control_item_id": "i0"}},
    {"short_name": "goal", "recommender_type": "gcsl", "params": SMALL}], ids=lambda m: m["short_name"])
def test_long_contracts(spark, rows, users, method):
    bundle = create_bundle(rows, users=users)
    handle = train(bundle, me.resolve(bundle.contract, method)[0])
    check(handle, rows, bundle.contract, ["NDCG_at_k", "roc_auc"])


def test_default_methods(spark, rows, users):
    wide = rows.groupBy("USER_ID").agg(F.max("OUTCOME").alias("ITEM_a"), F.min("OUTCOME").alias("ITEM_dead"),
                                       F.max(F.when(F.col("ITEM_ID") == "i2", F.col("OUTCOME"))).alias("ITEM_b")).fillna(0.0)
    wide = wide.withColumn("ITEM_a", (F.crc32("USER_ID") % 2).cast("double"))
    b = create_bundle(wide, users=users)
    m = dict(me.AUTO_SWEEPS["wide_multioutput"][0], params=SMALL)
    check(train(b, m), b.interactions, b.contract, ["roc_auc", "precision_at_k"], 2)
    with pytest.raises(ValueError, match="ITEM_dead"):
        train(b, m, {"on_degenerate_target": "raise"})
    with pytest.raises(ValueError, match="scorer_config"):
        train(b, m, {"other": 1})
    classes = rows.groupBy("USER_ID").agg(F.max("ITEM_ID").alias("ITEM_ID")).join(users, "USER_ID")
    b = create_bundle(classes)
    check(train(b), classes, "multiclass", ["recall_at_k"])
    seqs = rows.groupBy("USER_ID").agg(F.transform(F.array_sort(F.collect_list(F.struct("TIMESTAMP", "ITEM_ID"))), lambda x: x["ITEM_ID"]).alias("ITEM_SEQUENCE"))
    top = train(create_bundle(seqs)).top_k(seqs, 2).collect()
    assert len(top) >= 30 and {r["rank"] for r in top} <= {1, 2}
    sessions = seqs.select("USER_ID", F.array(F.slice("ITEM_SEQUENCE", 1, 4), F.slice("ITEM_SEQUENCE", 5, 4)).alias("SESSION_SEQUENCES"))
    h = train(create_bundle(sessions))
    assert h.top_k(sessions, 2).count() >= 30
    t = {(r["prev_item"], r["next_item"]): r["n"] for r in h.model.collect()}
    assert sum(t.values()) == pytest.approx(30 * 6 + 0.3 * 30)
    with pytest.raises(ValueError, match="nothing to train"):
        train(type(create_bundle(rows))(users, "users_features"))


def test_als_saves_its_id_maps(spark, rows):
    b = create_bundle(rows)
    h = train(b, me.resolve(b.contract, "als_universal")[0])
    root = tempfile.mkdtemp(prefix="ranklab-als-")
    rg.save_model(spark, root, "als1", h.model, "als", h.config)
    loaded, _ = rg.load_model(spark, root, "als1")
    from ranklab.operators import learners as ln
    a = sorted((r["USER_ID"], r["ITEM_ID"]) for r in ln.als_top_k(h.model, rows, 2).collect())
    assert a == sorted((r["USER_ID"], r["ITEM_ID"]) for r in ln.als_top_k(loaded, rows, 2).collect()) and len(a) == 60
    assert os.path.isdir(os.path.join(root, "als1", "model", "table_umap"))


def wide_of(rows):
    w = rows.groupBy("USER_ID").agg(F.max("OUTCOME").alias("ITEM_a"), F.max(F.when(F.col("ITEM_ID") == "i2", F.col("OUTCOME"))).alias("ITEM_b"))
    return w.fillna(0.0).withColumn("ITEM_a", (F.crc32("USER_ID") % 2).cast("double")).withColumn("ITEM_dead", F.lit(1.0))


KINDS = {
    "boosted": ("long", {"short_name": "m", "params": SMALL}),
    "fm": ("long", {"short_name": "m", "estimator": "fm", "estimator_type": "embedding", "params": {"embedding_dim": 2, "epochs": 1}}),
    "als": ("long", {"short_name": "m", "estimator": "als", "estimator_type": "embedding", "params": {"n_factors": 4, "epochs": 2}}),
    "item_trees": ("long", {"short_name": "m", "scorer_type": "independent", "params": SMALL}),
    "item_logistic": ("long", {"short_name": "m", "scorer_type": "independent", "estimator": "logistic"}),
    "uplift_x": ("long", {"short_name": "m", "recommender_type": "uplift", "params": SMALL | {"control_item_id": "i0", "learner": "x"}}),
    "goals": ("long", {"short_name": "m", "recommender_type": "gcsl", "params": SMALL}),
    "heads": ("wide", None),
    "classes": ("classes", None),
    "discriminant": ("classes", {"short_name": "m", "recommender_type": "ranking", "scorer_type": "multiclass", "estimator_type": "tabular",
                                 "estimator": "discriminant"}),
    "transitions": ("sequences", None),
    "contexts": ("sequences", {"short_name": "m", "recommender_type": "sequential", "scorer_type": "sequential", "estimator_type": "sequential",
                               "estimator": "markov", "params": {"order": 2}}),
}


@pytest.mark.parametrize("kind", KINDS)
def test_every_kind_is_saved_and_scores_alike(spark, rows, users, kind):
    shape, method = KINDS[kind]
    frame = {"long": lambda: rows, "wide": lambda: wide_of(rows), "classes": lambda: rows.groupBy("USER_ID").agg(F.max("ITEM_ID").alias("ITEM_ID")).join(users, "USER_ID"),
             "sequences": lambda: rows.groupBy("USER_ID").agg(F.transform(F.array_sort(F.collect_list(F.struct("TIMESTAMP", "ITEM_ID"))), lambda x: x["ITEM_ID"]).alias("ITEM_SEQUENCE"))}[shape]()
    bundle = create_bundle(frame) if shape in ("classes", "sequences") else create_bundle(frame, users=users)
    if shape == "wide":
        method = dict(me.AUTO_SWEEPS["wide_multioutput"][0], params=SMALL)
    if shape == "long" and "scorer_type" not in method:
        method = me.resolve(bundle.contract, method)[0]
    handle = train(bundle, method)
    handle.metrics = {"auc": 0.5}
    root = tempfile.mkdtemp(prefix="ranklab-models-")
    save_trained(spark, root, "m1", handle, ["a", "a", "b"])
    again = load_trained(spark, root, "m1", bundle)
    assert again.kind == handle.kind and again.config == handle.config and again.metrics == {"auc": 0.5}
    a, b = (sorted((r["USER_ID"], r["ITEM_ID"], r["rank"], round(r["score"], 6)) for r in h.top_k(bundle.interactions, 3).collect()) for h in (handle, again))
    assert a == b and a
    with pytest.raises(rg.RegistryError, match="exists"):
        save_trained(spark, root, "m1", handle)
    assert rg.list_models(spark, root, ["b"]).first()["tags"] == ["a", "b"]
