import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklab.operators import learners as ln


@pytest.fixture(scope="module")
def inter(spark):
    rnd = random.Random(5)
    rows = []
    for u in range(40):
        for _ in range(12):
            i = rnd.randint(0, 24)
            rows.append((f"u{u}", f"i{i}", float((u + i) % 3 == 0), float(u % 5), float(i % 7), u % 2 == 0))
    return spark.createDataFrame(rows, "USER_ID string, ITEM_ID string, OUTCOME double, f_user double, "
                                       "f_item double, treated boolean")


def test_index_ids_is_dense_and_ordered(spark, inter):
    m = {r["USER_ID"]: r["u"] for r in ln.index_ids(inter, "USER_ID", "u").collect()}
    assert sorted(m.values()) == list(range(40))
    assert [k for k, _ in sorted(m.items(), key=lambda kv: kv[1])] == sorted(m)


def test_als_top_k_invariants(spark, inter):
    h = ln.fit_als(inter, rank=4, max_iter=3, seed=1)
    top = ln.als_top_k(h, inter, 5).collect()
    per_user = {}
    for r in top:
        per_user.setdefault(r["USER_ID"], []).append(r["rank"])
    assert len(per_user) == 40 and all(sorted(v) == [1, 2, 3, 4, 5] for v in per_user.values())
    assert all(r["score"] == r["score"] for r in top)  # no NaN


def test_universal_gbt_scores_are_probabilities_and_seed_stable(spark, inter):
    kw = dict(numeric=["f_user", "f_item"], family="gbt", params={"n_estimators": 3, "max_depth": 2})
    a = ln.score_pairs(ln.fit_universal(inter, **kw), inter).select("score").collect()
    b = ln.score_pairs(ln.fit_universal(inter, **kw), inter).select("score").collect()
    assert all(0.0 <= r["score"] <= 1.0 for r in a) and a == b


def test_fm_and_regression(spark, inter):
    fm = ln.fit_universal(inter, ["f_user"], [], "fm", params={"embedding_dim": 2, "epochs": 1})
    assert ln.score_pairs(fm, inter).filter(F.col("score").isNull()).count() == 0
    reg = ln.fit_universal(inter, ["f_user", "f_item"], [], "gbt", "regression", params={"n_estimators": 2})
    assert ln.score_pairs(reg, inter, "regression").count() == inter.count()


def test_multioutput_constant_head(spark):
    df = spark.createDataFrame([(f"u{i}", float(i % 2), 1.0, float(i)) for i in range(30)],
                               "USER_ID string, ITEM_a double, ITEM_dead double, f double")
    fitted = ln.fit_multioutput(df, ["ITEM_a", "ITEM_dead"], ["f"], params={"n_estimators": 2, "max_depth": 2},
                                manifest={"ITEM_dead": 1.0})
    s = ln.score_multioutput(fitted, df)
    dead = {r["score"] for r in s.filter("target = 'ITEM_dead'").collect()}
    assert dead == {1.0} and s.filter("target = 'ITEM_a'").count() == 30


def test_multiclass(spark):
    df = spark.createDataFrame([(f"u{i}", ["A", "B", "C"][i % 3], float(i % 3), float(i)) for i in range(60)],
                               "USER_ID string, ITEM_ID string, f double, g double")
    pred = ln.fit_multiclass(df, ["f", "g"], max_iter=30).transform(df)
    acc = pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9


def test_uplift_learners(spark, inter):
    for fn in (ln.uplift_t_learner, ln.uplift_s_learner, ln.uplift_x_learner):
        out = fn(inter, ["f_user", "f_item"], "treated")
        assert out.count() == inter.count() and "uplift" in out.columns
        assert out.filter(F.col("uplift").isNull()).count() == 0
    t = ln.uplift_t_learner(inter, ["f_user", "f_item"], "treated").first()
    assert t["uplift"] == pytest.approx(t["mu1"] - t["mu0"])


def test_goal_conditioned_scores_use_goal(spark, inter):
    d = inter.withColumn("OUTCOME_rev", F.col("f_item") * 10)
    m = ln.fit_goal_conditioned(d, ["f_user"], ["OUTCOME_rev"], params={"n_estimators": 2, "max_depth": 2})
    s = ln.score_with_goals(m, d, {"OUTCOME_rev": 30.0})
    assert s.select("OUTCOME_rev").distinct().collect()[0][0] == 30.0


def test_independent_classifiers_match_spark_ml(spark, inter):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    cols = ["f_user"]
    models = ln.independent_classifiers(inter, cols, rounds=20, ridge=1e-6)
    assert models.count() == 25
    scored = ln.score_independent(models, inter.unionByName(inter.limit(1).withColumn("ITEM_ID", F.lit("unknown"))), cols)
    assert scored.count() == inter.count() + 1 and scored.filter("score is null").count() == 1
    item = "i3"
    part = VectorAssembler(inputCols=cols, outputCol="v").transform(inter.filter(F.col("ITEM_ID") == item))
    assert part.select("OUTCOME").distinct().count() == 2
    m = LogisticRegression(featuresCol="v", labelCol="OUTCOME", tol=1e-10, maxIter=200).fit(part)
    want = sorted(r["probability"][1] for r in m.transform(part).collect())
    got = sorted(r["score"] for r in scored.filter(F.col("ITEM_ID") == item).collect())
    assert got == pytest.approx(want, abs=0.02)


def test_als_pairs_serve_several_fits(spark, inter):
    pairs = ln.als_pairs(inter)
    assert pairs[0].columns == ["u", "i", "r"] and pairs[0].count() == inter.count()
    for rank in (2, 3):
        a, b = ln.fit_als(inter, rank=rank, max_iter=2, seed=1), ln.fit_als(inter, rank=rank, max_iter=2, seed=1, pairs=pairs)
        for x in ("userFactors", "itemFactors"):
            p, q = (dict(getattr(h.model, x).rdd.map(lambda r: (r["id"], list(r["features"]))).collect()) for h in (a, b))
            assert p.keys() == q.keys() and all(np.allclose(p[i], q[i], atol=1e-4) for i in p)


def test_large_models_send_their_factors_to_fewer_blocks():
    assert ln._als_blocks(15_000, 20_000, 480_000, 16) == ln._als_blocks(900_000, 1_200_000, 28_800_000, 16) == 10
    few = ln._als_blocks(5_400_000, 7_200_000, 173_000_000, 16)
    assert 3 <= few and few * (5_400_000 + 7_200_000) * 64 < 3e9                 # bytes a step sends
    assert ln._als_blocks(5_400_000, 7_200_000, 600_000_000, 16) * ln.BLOCK_RATINGS >= 600_000_000
