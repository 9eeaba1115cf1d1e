import math
import random

import pytest

from ranklab.operators import metrics as mt
from ranklab.operators import offpolicy as op
from ranklab.operators import scoring as sc
from ranklab.operators import stats as st


def _brute_auc(pairs):
    pos = [s for s, y in pairs if y > 0]
    neg = [s for s, y in pairs if y <= 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(pairs):
    P = sum(1 for _, y in pairs if y > 0)
    ap, prev_r = 0.0, 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(1 for s, y in pairs if s >= t and y > 0)
        fp = sum(1 for s, y in pairs if s >= t and y <= 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


@pytest.mark.parametrize("grouped", [False, True])
def test_auc_and_ap_match_brute_force(spark, grouped):
    rnd = random.Random(0)
    data = [("g", round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, score double, label long")
    m = mt.classification_metrics(df, "label", "score", ["g"] if grouped else []).first()
    pairs = [(s, y) for _, s, y in data]
    assert m["roc_auc"] == pytest.approx(_brute_auc(pairs), abs=1e-12)
    assert m["pr_auc"] == pytest.approx(_brute_ap(pairs), abs=1e-12)


def test_per_item_auc_fixture(spark):
    truth = spark.createDataFrame(
        [(f"u{i}", "good", float(y)) for i, y in enumerate([1, 0, 1, 0])] +
        [(f"u{i}", "dead", 1.0) for i in range(4)], "USER_ID string, ITEM_ID string, OUTCOME double")
    scores = spark.createDataFrame(
        [(f"u{i}", "good", s) for i, s in enumerate([.8, .2, .9, .1])] +
        [(f"u{i}", "dead", s) for i, s in enumerate([.5, .4, .7, .3])], "USER_ID string, ITEM_ID string, score double")
    out = {r["ITEM_ID"]: r["roc_auc"] for r in mt.per_item_auc(scores, truth).collect()}
    assert out["good"] == 1.0 and out["dead"] is None


def _brute_ranking(logged, ranks, k):
    """logged: {inst: [(user,item,reward)]}; ranks: {(user,item): rank}"""
    prec, rec, ap, ndcg, mrr, npos_inst = [], [], [], [], [], 0
    for inst, rows in logged.items():
        rr = [(ranks.get((u, i)), r) for u, i, r in rows]
        hits = [rk for rk, r in rr if r > 0 and rk is not None and rk <= k]
        npos = sum(1 for _, r in rr if r > 0)
        prec.append(len(hits) / k)
        if npos:
            npos_inst += 1
            rec.append(len(hits) / npos)
        a = sum(sum(1 for h in hits if h <= x) / x for x in hits)
        ap.append(a / len(hits) if hits else 0.0)
        dcg = sum(r / math.log2(rk + 1) for rk, r in rr if rk is not None and rk <= k)
        ideal = sorted((r for _, r in rr), reverse=True)[:k]
        idcg = sum(r / math.log2(j + 2) for j, r in enumerate(ideal) if r > 0)
        ndcg.append(dcg / idcg if idcg > 0 else 0.0)
        mrr.append(1 / min(hits) if hits else 0.0)
    n = len(logged)
    return {"precision": sum(prec) / n, "recall": sum(rec) / npos_inst, "map": sum(ap) / n,
            "ndcg": sum(ndcg) / n, "mrr": sum(mrr) / n}


def test_ranking_metrics_match_brute_force(spark):
    rnd = random.Random(1)
    users = [f"u{i}" for i in range(15)]
    items = [f"i{j}" for j in range(12)]
    ranks = {}
    for u in users:
        for pos, it in enumerate(rnd.sample(items, 6)):
            ranks[(u, it)] = pos + 1
    logged = {}
    for u in users:
        logged[u] = [(u, it, float(rnd.choice([0, 1, 1, 2]))) for it in rnd.sample(items, 4)]
    ldf = spark.createDataFrame([(inst, u, i, r) for inst, rows in logged.items() for u, i, r in rows],
                                "INSTANCE string, USER_ID string, ITEM_ID string, REWARD double")
    rdf = spark.createDataFrame([(u, i, r) for (u, i), r in ranks.items()], "USER_ID string, ITEM_ID string, rank long")
    got = {(r["metric"], r["k"]): r["value"] for r in mt.ranking_metrics(ldf, rdf, [3, 5]).collect()}
    for k in (3, 5):
        want = _brute_ranking(logged, ranks, k)
        for m, v in want.items():
            assert got[(m, k)] == pytest.approx(v, abs=1e-12), (m, k)


def test_single_item_fast_path_agrees(spark):
    rnd = random.Random(2)
    rows = [(f"r{i}", f"u{i % 7}", f"i{rnd.randint(0, 9)}", float(rnd.randint(0, 1))) for i in range(80)]
    ldf = spark.createDataFrame(rows, "INSTANCE string, USER_ID string, ITEM_ID string, REWARD double")
    top = spark.createDataFrame([(f"i{j}", j + 1) for j in range(5)], "ITEM_ID string, rank long")
    a = {(r["metric"], r["k"]): r["value"] for r in mt.ranking_metrics(ldf, top, [3, 5]).collect()}
    b = {(r["metric"], r["k"]): r["value"] for r in mt.ranking_metrics(ldf, top, [3, 5], True).collect()}
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=1e-12)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0)], "label double, score double")
    r = mt.regression_metrics(df).first()
    assert r["mae"] == pytest.approx(0.5) and r["rmse"] == pytest.approx(math.sqrt(0.5))


def test_snips_equals_ips_when_weights_are_one(spark):
    # eps = 1 and uniform logging over |A| actions -> pi = b = 1/|A| -> w = 1
    logged = spark.createDataFrame([(str(i), "u", f"i{i % 4}", float(i % 2), 0.25) for i in range(40)],
                                   "INSTANCE string, USER_ID string, ITEM_ID string, REWARD double, PROPENSITY double")
    q = spark.createDataFrame([(f"i{j}", 0.5) for j in range(4)], "ITEM_ID string, q double")
    top1 = spark.createDataFrame([("i0",)], "ITEM_ID string")
    got = {r["metric"]: r["value"] for r in op.off_policy_estimates(logged, q, epsilon=1.0, top1=top1).collect()}
    assert got["IPS"] == pytest.approx(got["SNIPS"]) == pytest.approx(0.5)
    assert got["direct_method"] == pytest.approx(0.5)


def test_offpolicy_requires_columns(spark):
    df = spark.createDataFrame([("1", "i", 1.0)], "INSTANCE string, ITEM_ID string, REWARD double")
    with pytest.raises(ValueError, match="PROPENSITY"):
        op.check_inputs(df)


def test_exact_percentile_matches_linear_interpolation(spark):
    vals = [random.Random(4).randint(0, 50) for _ in range(101)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    s = sorted(vals)
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        h = (len(s) - 1) * p
        lo, hi = math.floor(h), math.ceil(h)
        assert st.exact_percentile(df, "x", p) == pytest.approx(s[lo] + (h - lo) * (s[hi] - s[lo]))


def test_top_k_per_user_and_candidates(spark):
    s = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 3.0), ("a", "z", 1.0), ("b", "x", 0.5)],
                              "USER_ID string, ITEM_ID string, score double")
    top = {(r["USER_ID"], r["rank"]): r["ITEM_ID"] for r in sc.top_k_per_user(s, 2).collect()}
    assert top == {("a", 1): "x", ("a", 2): "y", ("b", 1): "x"}
    cand = spark.createDataFrame([("z",)], "ITEM_ID string")
    assert [r["ITEM_ID"] for r in sc.restrict_candidates(s, cand).collect()] == ["z"]
    with pytest.raises(ValueError, match="multi-output"):
        sc.restrict_candidates(s, cand, scorer_type="multioutput")


def test_transitions(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "x", 1), ("b", "z", 2)],
                               "USER_ID string, ITEM_ID string, TIMESTAMP long")
    got = {(r["prev_item"], r["next_item"]): r["prob"] for r in sc.transition_scores(df).collect()}
    assert got == {("x", "y"): 0.5, ("x", "z"): 0.5, ("y", "x"): 1.0}


def test_goal_values_methods(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "OUTCOME_r double")
    assert st.goal_values(df, ["OUTCOME_r"], "mean_scalarization") == {"OUTCOME_r": 5.0}
    assert st.goal_values(df, ["OUTCOME_r"], "percentile_value", p=0.9) == {"OUTCOME_r": pytest.approx(9.0)}
    assert st.goal_values(df, ["OUTCOME_r"], "predefined_value", predefined={"OUTCOME_r": 3}) == {"OUTCOME_r": 3.0}
    with pytest.raises(ValueError, match="missing"):
        st.goal_values(df, ["OUTCOME_r"], "predefined_value", predefined={})
    with pytest.raises(ValueError):
        st.goal_values(df, ["OUTCOME_r"], "nope")
