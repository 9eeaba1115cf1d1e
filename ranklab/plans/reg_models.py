"""Registered checks: fitted models (rows-only, no SQL oracle), the SQL-expressible
independent per-item models, and data-aware method eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklab.operators import boosting as bo
from ranklab.operators import learners as ln
from ranklab.operators import metrics as mt
from ranklab.operators import profile as pf
from ranklab.operators import scoring as sc
from ranklab.operators import sparse as spw
from ranklab.operators import split as sp
from ranklab.operators import stats as st
from ranklab.plans import sql_views as V
from ranklab.plans.registering import r6, registry, temporal_parts
from ranklab.plans import methods as me
from ranklab.plans import sweep as sw
from ranklab.session import materialize
from ranklab.sources import tables as T

QUERIES, ORACLE, register = registry()



def _features(df, spark, sf):
    return df.join(T.users(spark, sf), "USER_ID", "left").join(T.items(spark, sf), "ITEM_ID", "left")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]     # fixed values: order priorities of the shared tables
NUMERIC = ["nation", "acctbal", "size", "retailprice"]
CATEGORICAL = ["segment", "brand"]


# ------------------------------------------------------------------ SQL-checked

@register("independent_item_models", f"""
WITH {V.INTER}, {V.USERS}
SELECT ITEM_ID, round(regr_slope(OUTCOME, acctbal / 1000), 6) + 0.0 AS slope,
       round(regr_intercept(OUTCOME, acctbal / 1000), 6) + 0.0 AS intercept,
       CAST(regr_count(OUTCOME, acctbal / 1000) AS BIGINT) AS n
FROM inter JOIN users USING (USER_ID) GROUP BY ITEM_ID""")
def q_independent(spark, sf):
    j = T.interactions(spark, sf).join(T.users(spark, sf), "USER_ID") \
        .withColumn("acctbal_k", F.col("acctbal") / 1000.0)
    m = ln.independent_linear(j, "acctbal_k")
    return m.select("ITEM_ID", r6("slope"), r6("intercept"), F.col("n").cast("long").alias("n"))


@register("linear_heads_parts", f"""
WITH {V.INTER}, {V.USERS},
c AS (SELECT USER_ID, ITEM_ID, max(OUTCOME) AS v FROM inter GROUP BY ALL),
x AS (SELECT USER_ID, acctbal / 1000 AS x FROM users WHERE USER_ID IN (SELECT USER_ID FROM inter)),
g AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM x),
s AS (SELECT ITEM_ID, sum(v) AS sy, sum(v * x) AS sxy FROM c JOIN x USING (USER_ID) GROUP BY ITEM_ID),
b AS (SELECT ITEM_ID, n, sx, sy, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM s, g)
SELECT 'ITEM_' || ITEM_ID AS ITEM_ID, round(slope, 6) + 0.0 AS slope, round((sy - slope * sx) / n, 6) + 0.0 AS intercept FROM b""")
def q_linear_heads(spark, sf):
    """M5, M6 with a target a part: least squares of each on the customers' balance, customers without the part counting as 0."""
    d = T.interactions(spark, sf).select("USER_ID", "ITEM_ID", "OUTCOME")
    u = T.users(spark, sf).select("USER_ID", (F.col("acctbal") / 1000).alias("balance"))
    h = spw.linear_heads(spw.pivot_sparse(d.join(u, "USER_ID")), ["balance"])
    return h.select("ITEM_ID", (F.round(F.col("beta")[1], 6) + 0.0).alias("slope"), (F.round(F.col("beta")[0], 6) + 0.0).alias("intercept"))


def _lines(spark, sf):
    """Order lines with the part as the class of what was ordered."""
    t = T.table(spark, sf, "lineitem")
    return t.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("string").alias("USER_ID"), F.col("l_partkey").alias("ITEM_ID"),
                    F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice").cast("double") / 1000).alias("price"))


@register("discriminant_parts", """
WITH d AS (SELECT l_partkey AS c, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) / 1000 AS p FROM lineitem),
t AS (SELECT count(*) AS n, avg(q) AS q0, avg(p) AS p0 FROM d),
m AS (SELECT c, count(*) AS n, avg(q) AS mq, avg(p) AS mp FROM d GROUP BY c),
w AS (SELECT sum((q - mq) * (q - mq)) AS qq, sum((q - mq) * (p - mp)) AS qp, sum((p - mp) * (p - mp)) AS pp FROM d JOIN m USING (c)),
k AS (SELECT w.qq / (t.n - (SELECT count(*) FROM m)) AS qq, w.qp / (t.n - (SELECT count(*) FROM m)) AS qp, w.pp / (t.n - (SELECT count(*) FROM m)) AS pp,
             t.n AS total, q0, p0 FROM w, t),
i AS (SELECT total, q0, p0, 1.001 / (1.001 * 1.001 - qp * qp / (qq * pp)) / qq AS a, 1.001 / (1.001 * 1.001 - qp * qp / (qq * pp)) / pp AS b,
             -(qp / (qq * pp)) / (1.001 * 1.001 - qp * qp / (qq * pp)) AS o FROM k),
s AS (SELECT c, n, total, q0, p0, mq - q0 AS dq, mp - p0 AS dp, a * (mq - q0) + o * (mp - p0) AS sq, o * (mq - q0) + b * (mp - p0) AS sp FROM m, i)
SELECT c AS ITEM_ID, round(ln(n / total) - (sq * dq + sp * dp) / 2 - sq * q0 - sp * p0, 6) + 0.0 AS intercept,
       round(sq, 6) + 0.0 AS quantity, round(sp, 6) + 0.0 AS price FROM s""")
def q_discriminant(spark, sf):
    """M4 with a class a part: the linear score of every class on quantity and price of an order line."""
    m = spw.fit_discriminant(_lines(spark, sf), ["quantity", "price"])
    return m.select("ITEM_ID", *[(F.round(F.col("beta")[j], 6) + 0.0).alias(n) for j, n in enumerate(("intercept", "quantity", "price"))])


_METHODS = ("gbt_universal", "als_universal", "fm_universal", "markov_sequential")


@register("method_eligibility_interactions", f"""
WITH {V.INTER},
p AS (SELECT count(*) AS n, 1 - count(*) / (count(DISTINCT USER_ID) * count(DISTINCT ITEM_ID)) AS sparsity,
             CASE WHEN count(DISTINCT OUTCOME) <= 1 THEN 'constant' WHEN bool_and(OUTCOME IN (0, 1)) THEN 'binary'
                  ELSE 'continuous' END AS tt FROM inter),
t AS (SELECT *, CASE WHEN n < 5000 THEN 'tiny' WHEN n < 100000 THEN 'small' WHEN n < 1000000 THEN 'medium'
                     ELSE 'large' END AS tier FROM p),
m AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in _METHODS)}) v(method)),
k AS (SELECT m.method, t.tier,
        CASE WHEN m.method = 'gbt_universal' THEN TRUE
             WHEN t.tt = 'continuous' AND m.method <> 'markov_sequential' THEN FALSE
             WHEN m.method = 'als_universal' THEN t.sparsity >= 0.9 AND t.n >= 1000
             WHEN m.method = 'fm_universal' THEN t.n >= 5000
             WHEN m.method = 'markov_sequential' THEN t.n >= 1000 END AS kept
      FROM m CROSS JOIN t)
SELECT method, kept, CASE WHEN kept THEN method || '_' || tier END AS sized_name, tier FROM k""")
def q_eligibility(spark, sf):
    prof = pf.bundle_profile(T.interactions(spark, sf), T.users(spark, sf), T.items(spark, sf))
    methods = me.as_table(spark, [m for m in me.AUTO_SWEEPS["long_with_timestamp"] if m["short_name"] in _METHODS])
    return me.advice(methods, prof).select(F.col("short_name").alias("method"), "kept", "sized_name", "tier")


@register("method_capability", """
WITH rs(r, s) AS (VALUES ('ranking', 'universal'), ('ranking', 'multiclass'), ('ranking', 'multioutput'), ('ranking', 'independent'),
  ('bandits', 'universal'), ('bandits', 'independent'), ('uplift', 'universal'), ('uplift', 'independent'), ('gcsl', 'universal'),
  ('gcsl', 'independent'), ('sequential', 'sequential'), ('hierarchical_sequential', 'hierarchical')),
se(s, e) AS (VALUES ('universal', 'tabular'), ('universal', 'embedding'), ('independent', 'tabular'), ('multiclass', 'tabular'),
  ('multioutput', 'tabular'), ('sequential', 'sequential'), ('hierarchical', 'sequential')),
cap AS (SELECT r, s, e FROM rs JOIN se USING (s)),
cand AS (SELECT r, s, e, (SELECT count(*) FROM lineitem) AS n FROM (SELECT DISTINCT r FROM rs), (SELECT DISTINCT s FROM se), (SELECT DISTINCT e FROM se))
SELECT c.r AS recommender_type, c.s AS scorer_type, c.e AS estimator_type, cap.r IS NOT NULL AS fits,
       CASE WHEN cap.r IS NOT NULL THEN NULL
            WHEN rs.r IS NULL THEN concat('recommender ', chr(39), c.r, chr(39), ' does not accept scorer ', chr(39), c.s, chr(39))
            ELSE concat('scorer ', chr(39), c.s, chr(39), ' does not accept estimator family ', chr(39), c.e, chr(39)) END AS reason,
       CAST(c.n AS BIGINT) AS n_rows
FROM cand c LEFT JOIN cap USING (r, s, e) LEFT JOIN rs USING (r, s)""")
def q_capability(spark, sf):
    """Every triple against the capability table, beside the size of the data it would train on."""
    cap = me.capability(spark)
    axes = [cap.select(c).distinct() for c in me.TRIPLE]
    cand = axes[0].crossJoin(axes[1]).crossJoin(axes[2])   # fixed tables of a few names each
    cand = cand.select(F.concat_ws("/", *me.TRIPLE).alias("short_name"), *me.TRIPLE)
    good = me.compatible(cand).select(*me.TRIPLE, F.lit(True).alias("fits"), F.lit(None).cast("string").alias("reason"))
    bad = cand.join(me.incompatible(cand), "short_name").select(*me.TRIPLE, F.lit(False).alias("fits"), "reason")
    n = T.table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))
    return good.unionByName(bad).crossJoin(F.broadcast(n))   # one row


# ------------------------------------------------------------------ fitted models (rows-only)

def _held_out(df):
    """(fit rows, scored rows): a fifth of the users, by a hash of their id, is only scored."""
    out = F.crc32("USER_ID") % 5 == 0
    return df.filter(~out), df.filter(out)


_PAIRS = ["USER_ID", "ITEM_ID", "OUTCOME"]


@register("als_ranking_metrics")
def q_als(spark, sf):
    """M9 + M15/M16: ALS on train, top-10 per validation user, per-row ranking metrics."""
    train, valid = temporal_parts(spark, sf, cols=_PAIRS)
    h = ln.fit_als(train, rank=16, max_iter=5, reg=0.1)
    top = ln.als_top_k(h, valid, 10)
    res = mt.ranking_metrics(mt.logged_per_row(valid, None), top, [10], single_item_instances=True)
    return res.select("metric", "k", r6("value"))


@register("gbt_universal_auc")
def q_gbt(spark, sf):
    """M1: GBT classifier over user and item features; scored on the validation pairs."""
    train, valid = temporal_parts(spark, sf)
    m = ln.fit_universal(_features(train, spark, sf), NUMERIC, CATEGORICAL, "gbt",
                         params={"n_estimators": 50, "max_depth": 4})
    scored = ln.score_pairs(m, _features(valid, spark, sf))
    return mt.classification_metrics(scored, "OUTCOME", "score").select(r6("roc_auc"), r6("pr_auc"), "n_pos", "n_neg")


@register("gbt_regressor_revenue")
def q_gbt_reg(spark, sf):
    """M2: GBT regressor on the continuous revenue outcome."""
    train, valid = temporal_parts(spark, sf)
    m = ln.fit_universal(_features(train, spark, sf), NUMERIC, CATEGORICAL, "gbt", "regression",
                         label="OUTCOME_revenue", params={"n_estimators": 50, "max_depth": 4})
    scored = ln.score_pairs(m, _features(valid, spark, sf), "regression")
    return mt.regression_metrics(scored, "OUTCOME_revenue", "score").select(r6("rmse"), r6("mae"), "n")


@register("fm_universal_auc")
def q_fm(spark, sf):
    """Factorization machine over user and item ids, segment, brand and numbers; parameters in tables."""
    train, valid = temporal_parts(spark, sf, cols=_PAIRS)
    m = ln.fit_universal(_features(train, spark, sf), ["acctbal", "retailprice"], CATEGORICAL, "fm",
                         params={"embedding_dim": 8, "epochs": 3})
    scored = ln.score_pairs(m, _features(valid, spark, sf))
    return mt.classification_metrics(scored, "OUTCOME", "score").select(r6("roc_auc"), r6("pr_auc"), "n_pos", "n_neg")


@register("multiclass_segments")
def q_multiclass(spark, sf):
    """M4: customer segment as the class; accuracy and mean probability of the true class."""
    fit, held = _held_out(T.customer_classes(spark, sf))
    m = ln.fit_multiclass(fit, ["c_nationkey", "c_acctbal"], max_iter=20)
    pred = m.transform(held)
    return pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n")).select(r6("accuracy"), "n")


@register("discriminant_parts_metrics")
def q_discriminant_metrics(spark, sf):
    """M4 with a class a part, held-out order lines: how often the true part is among the ten best classes, and its mean reciprocal rank."""
    fit, held = _held_out(_lines(spark, sf))
    m = spw.fit_discriminant(fit, ["quantity", "price"])
    top = spw.discriminant_top_k(m, held, ["quantity", "price"], 10).withColumnRenamed("ITEM_ID", "_guess")
    hit = held.join(top, (held["USER_ID"] == top["USER_ID"]) & (held["ITEM_ID"] == top["_guess"]), "left")
    return hit.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall_10"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr_10"),
                   F.count(F.lit(1)).alias("n")).select(r6("recall_10"), r6("mrr_10"), "n")


@register("multioutput_labels")
def q_multioutput(spark, sf):
    """M5: one head per ITEM_* target on a shared vector; per-target AUC."""
    fit, lab = _held_out(T.labelled_docs(spark, sf))
    fitted = ln.fit_multioutput(fit, ["ITEM_quality", "ITEM_toxic"], ["n_chars"], ["lang"], params={"n_estimators": 50, "max_depth": 4})
    scores = ln.score_multioutput(fitted, lab)
    truth = lab.unpivot(["USER_ID"], ["ITEM_quality", "ITEM_toxic"], "target", "label")
    j = scores.join(truth, ["USER_ID", "target"])
    return mt.classification_metrics(j, "label", "score", ["target"]).select(
        "target", r6("roc_auc"), r6("pr_auc"), "n_pos", "n_neg")


@register("multioutput_spend_regression")
def q_multioutput_regression(spark, sf):
    """M6: a continuous head an order priority (what a customer spends on it), all heads in the same passes; error on held-out customers."""
    wide = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("USER_ID")).agg(
        *[F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice").cast("double"))).alias(f"ITEM_{p[0]}") for p in PRIORITIES])
    targets = [f"ITEM_{p[0]}" for p in PRIORITIES]
    fit, held = _held_out(wide.join(T.users(spark, sf), "USER_ID"))
    fitted = ln.fit_multioutput(fit, targets, ["nation", "acctbal"], ["segment"], "regression", {"n_estimators": 50, "max_depth": 4})
    truth = held.unpivot(["USER_ID"], targets, "target", "truth").filter("truth is not null")
    j = ln.score_multioutput(fitted, held).join(truth, ["USER_ID", "target"])
    e = F.col("score") - F.col("truth")
    return j.groupBy("target").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n")) \
        .select("target", r6("rmse"), r6("mae"), "n")


@register("independent_trees_priorities")
def q_independent_trees(spark, sf):
    """M3: separate boosted trees for every order priority; per-item AUC of the big-order flag on held-out customers."""
    fit, held = _held_out(T.priorities(spark, sf).join(T.users(spark, sf), "USER_ID"))
    fitted = bo.fit_by_item(fit, ["acctbal", "nation"], categorical=["segment"], n_trees=50, depth=4)
    return mt.classification_metrics(bo.score_by_item(fitted, held), "OUTCOME", "score", ["ITEM_ID"]).select("ITEM_ID", r6("roc_auc"), "n_pos", "n_neg")


def _large_quantity(spark, sf):
    j = T.interactions(spark, sf).join(T.users(spark, sf), "USER_ID")
    return j.withColumn("t", F.col("l_quantity") >= 25)


@register("uplift_learners_segments")
def q_uplift_learners(spark, sf):
    """T-, S- and X-learner effect of a large quantity on returns, mean per segment; every row is scored by models that did not see its user."""
    j = materialize(_large_quantity(spark, sf), "treated")
    # the X-learner's first stage is the T-learner
    x = ln.score_uplift(ln.fit_uplift(j, ["acctbal", "nation"], "t", learner="x"), j).groupBy("segment").agg(
        *[f(c).alias(f"{n}_{v}") for n, c in (("t", F.col("mu1") - F.col("mu0")), ("x", F.col("uplift"))) for v, f in (("learner", F.avg), ("spread", F.stddev))])
    s = ln.score_uplift(ln.fit_uplift(j, ["acctbal", "nation"], "t", learner="s"), j).groupBy("segment").agg(
        F.avg("uplift").alias("s_learner"), F.stddev("uplift").alias("s_spread"))
    return x.join(s, "segment").select("segment", *[r6(f"{n}_{v}") for n in ("t", "s", "x") for v in ("learner", "spread")])


@register("uplift_qini_returns")
def q_qini(spark, sf):
    """Qini curve of the cross-fitted T-learner over tenths of the rows, best effects first."""
    j = materialize(_large_quantity(spark, sf), "treated")
    s = ln.score_uplift(ln.fit_uplift(j, ["acctbal", "nation"], "t"), j)
    return sc.qini_curve(s, "score", "t", "OUTCOME", tie_cols=T.INTER_TIEBREAK).select("bucket", "n", r6("qini"), r6("random"))


@register("goal_conditioned_scores")
def q_gcsl(spark, sf):
    """Revenue as a goal feature at fit time; scored at the 90th-percentile goal."""
    train, valid = temporal_parts(spark, sf)
    ft = _features(train, spark, sf)
    m = ln.fit_goal_conditioned(ft, NUMERIC, ["OUTCOME_revenue"], params={"n_estimators": 50, "max_depth": 4}, categorical=CATEGORICAL)
    goal = st.goal_values(train, ["OUTCOME_revenue"], "percentile_value", p=0.9)
    scored = ln.score_with_goals(m, _features(valid, spark, sf), goal)
    return mt.classification_metrics(scored, "OUTCOME", "score").select(r6("roc_auc"), "n_pos", "n_neg")


@register("markov_next_item_metrics")
def q_markov(spark, sf):
    """First-order transitions from train histories; next-event ranking for the
    last event of each user (leave-last-one split)."""
    ev = T.events(spark, sf)
    s = sp.leave_last_n_per_user(ev, n_valid=0, n_test=1, tiebreak=["event_id"])
    train = s.filter(F.col("split") == "train")
    order = ("TIMESTAMP", "event_id")
    ranks = sc.next_items(train, sc.transition_scores(train, order_cols=order), 3, order_cols=order)
    held = s.filter(F.col("split") == "test").withColumn("OUTCOME", F.lit(1.0))
    res = mt.ranking_metrics(mt.logged_per_row(held, ["event_id"]), ranks, [1, 3], single_item_instances=True)
    return res.select("metric", "k", r6("value"))


@register("sweep_leaderboard_interactions")
def q_sweep(spark, sf):
    """L7-L16 end to end: eligibility on the data profile, then a concurrent,
    failure-isolated sweep of three Spark ML methods on one written split,
    ranked by ROC AUC on the validation pairs (each method scores the pairs
    it can score - no user x item product)."""
    train, valid = temporal_parts(spark, sf, cols=_PAIRS)
    requested = me.resolve("long_interactions", [
        {"short_name": "gbt_universal", "estimator": "gbt", "params": {"n_estimators": 50, "max_depth": 4}},
        {"short_name": "als_universal", "estimator_type": "embedding", "estimator": "als",
         "params": {"n_factors": 16, "epochs": 5}},
        {"short_name": "fm_universal", "estimator_type": "embedding", "estimator": "fm",
         "params": {"embedding_dim": 4, "epochs": 2}},
    ])
    fits = {r["short_name"] for r in me.compatible(me.as_table(spark, requested)).collect()}
    ft, fv = _features(train, spark, sf), _features(valid, spark, sf)
    n_logged = valid.count()

    def fit_eval(m):
        if m["estimator"] == "als":
            h = ln.fit_als(train, rank=m["params"]["n_factors"], max_iter=m["params"]["epochs"])
            # pairs that ALS does not know score 0, so that every method is judged on the same rows
            scored = valid.join(ln.als_pair_scores(h, valid), ["USER_ID", "ITEM_ID"], "left").fillna(0.0, ["score"])
        else:
            model = ln.fit_universal(ft, NUMERIC if m["estimator"] == "gbt" else ["acctbal", "retailprice"],
                                     CATEGORICAL if m["estimator"] == "gbt" else [], m["estimator"],
                                     params=m["params"])
            scored = ln.score_pairs(model, fv)
        r = mt.classification_metrics(scored, "OUTCOME", "score").first()
        if r["n_pos"] + r["n_neg"] != n_logged:
            raise RuntimeError("methods must be judged on the same rows")
        return {"roc_auc": r["roc_auc"]}

    rows = sw.sweep([m for m in requested if m["short_name"] in fits], fit_eval, bundle_id=f"inter:{sf}", primary_metric="roc_auc",
                    max_workers=3, keep_top_k=2)
    out = [(r["model_id"], r["status"], r["position"], r["keep"],
            None if r.get("metrics", {}).get("roc_auc") is None else round(r["metrics"]["roc_auc"], 6))
           for r in rows]
    return spark.createDataFrame(out, "model_id string, status string, position int, keep boolean, roc_auc double")


@register("search_trials_als")
def q_search(spark, sf):
    """Quasi-random (Halton) search over ALS factors, epochs and regularisation;
    trials fitted in parallel on one written split, ranked by NDCG@10 (best first)."""
    train, valid = temporal_parts(spark, sf, cols=_PAIRS)
    logged, pairs = mt.logged_per_row(valid, None), ln.als_pairs(train)      # ids are numbered once for all trials

    def fit_eval(m):
        p = m["params"]
        h = ln.fit_als(train, rank=int(p["n_factors"]), max_iter=int(p["epochs"]), reg=float(p["reg"]), pairs=pairs)
        res = mt.ranking_metrics(logged, ln.als_top_k(h, valid, 10), [10], single_item_instances=True)
        return {f"{r['metric']}@10": r["value"] for r in res.collect()}

    base = me.resolve("long_interactions", "als_universal")[0]
    space = {"n_factors": ("int", 4, 16, {"step": 4}), "epochs": ("int", 2, 5, {}),
             "reg": ("float", 0.01, 1.0, {"log": True})}
    trials = sw.search(base, space, fit_eval, n_trials=3, sampler="qmc", metric="ndcg@10", max_workers=3)
    rows = [(t["trial"], int(t["params"]["n_factors"]), int(t["params"]["epochs"]), round(t["params"]["reg"], 6),
             None if t["value"] is None else round(t["value"], 6), t["status"], i + 1) for i, t in enumerate(trials)]
    return spark.createDataFrame(rows, "trial int, n_factors int, epochs int, reg double, ndcg_at_10 double, "
                                       "status string, position int")


@register("independent_classifiers_priorities")
def q_independent_classifiers(spark, sf):
    """M3: one logistic regression per order priority on customer features, all fitted in the
    same passes; per-item AUC of the big-order flag."""
    prio = T.priorities(spark, sf).join(T.users(spark, sf), "USER_ID")
    fit, held = _held_out(prio)
    scored = ln.score_independent(ln.independent_classifiers(fit, ["acctbal", "nation"]), held, ["acctbal", "nation"])
    return mt.classification_metrics(scored, "OUTCOME", "score", ["ITEM_ID"]).select(
        "ITEM_ID", r6("roc_auc"), "n_pos", "n_neg")
