"""Off-policy estimators (E16-E22) over long logged tables.

Inputs per logged row: INSTANCE, USER_ID, ITEM_ID (the logged action), REWARD,
PROPENSITY (logging probability b(a|x)). The target policy is epsilon-greedy
over a ranking: pi(a|x) = (1-eps)*[a = top1(x)] + eps/|A|. Everything an
estimator needs reduces to joins with the top-1 table and one scalar |A|, so
no (instance x action) table is ever built.

Estimators (``avg`` over logged rows):
  replay_match     avg(r) over rows whose logged action equals top1(x)
  IPS              avg(w r), w = pi(a|x)/b(a|x)
  SNIPS            sum(w r)/sum(w)
  direct_method    avg over rows of sum_a pi(a|x) q(a)
                     = (1-eps) q(top1(x)) + eps * mean_a q(a)
  DR               DM + avg(w (r - q(a_logged)))
  policy_weighted  sum(pi r)/sum(pi)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("INSTANCE", "ITEM_ID", "REWARD", "PROPENSITY")
ESTIMATORS = ("replay_match", "IPS", "SNIPS", "direct_method", "DR", "policy_weighted")


def empirical_propensity(logged: DataFrame, segment_cols=(), item_col: str = "ITEM_ID") -> DataFrame:
    """E22 helper: b(a|segment) = share of action a among the segment's logged rows.

    Counts per (segment, action) and per segment are partial aggregations; the
    per-segment totals join back on the segment key (without segments, one row is
    broadcast to all counts).
    """
    seg = list(segment_cols)
    counts = logged.groupBy(*seg, item_col).agg(F.count(F.lit(1)).alias("_na"))
    totals = logged.groupBy(*seg).agg(F.count(F.lit(1)).alias("_ns"))
    both = counts.join(totals, seg) if seg else counts.crossJoin(F.broadcast(totals))   # without segments, one row of totals
    prop = both.select(*seg, item_col, (F.col("_na") / F.col("_ns")).alias("PROPENSITY"))
    return logged.join(prop, [*seg, item_col], "left")


def check_inputs(logged: DataFrame, needs_propensity: bool = True) -> None:
    """Required columns for off-policy evaluation."""
    need = [c for c in REQUIRED if needs_propensity or c != "PROPENSITY"]
    missing = [c for c in need if c not in logged.columns]
    if missing:
        raise ValueError(f"off-policy evaluation needs columns {missing} (logged items, rewards, "
                         "logging propensities); use empirical_propensity() to estimate b(a|x)")


def off_policy_estimates(logged: DataFrame, q: DataFrame, epsilon: float = 0.1,
                         top1: DataFrame | None = None) -> DataFrame:
    """All six estimators in one aggregation -> (metric, value).

    ``q``: (ITEM_ID, q) expected-reward model; unseen actions get q = 0 and |A|
    is the number of actions in ``q``. ``top1``: the policy's greedy action,
    (USER_ID, ITEM_ID) per user or a one-row (ITEM_ID); when None the policy is greedy on ``q``
    itself (one global action). The q statistics (|A|, mean q and, for the
    global policy, the argmax with ties by item id) come from one aggregation.
    """
    weighted = "PROPENSITY" in logged.columns   # without it, only the estimators that need none
    check_inputs(logged, needs_propensity=False)
    eps = float(epsilon)
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("m"),
                  F.min_by(F.struct("ITEM_ID", "q"), F.struct((-F.col("q")).alias("nq"), "ITEM_ID")).alias("top")
                  ).first()
    n_actions, q_mean = stats["n"], stats["m"] or 0.0
    qq = q.select("ITEM_ID", "q")
    if top1 is not None and "USER_ID" not in top1.columns:
        # A global policy given as a one-row table.
        item = top1.select("ITEM_ID").first()[0]
        qtop = q.filter(F.col("ITEM_ID") == F.lit(item)).select("q").first()
        stats = {"top": {"ITEM_ID": item, "q": qtop[0] if qtop else 0.0}, "n": n_actions, "m": q_mean}
        top1 = None
    if top1 is not None:
        t = top1.select("USER_ID", F.col("ITEM_ID").alias("_top"))
        j = logged.join(t, "USER_ID", "left").join(
            qq.select(F.col("ITEM_ID").alias("_top"), F.col("q").alias("_qtop")), "_top", "left")
    else:
        j = logged.withColumn("_top", F.lit(stats["top"]["ITEM_ID"])).withColumn(
            "_qtop", F.lit(float(stats["top"]["q"])))
    j = j.join(qq, "ITEM_ID", "left").withColumn("_q", F.coalesce(F.col("q"), F.lit(0.0))).drop("q")
    match = (F.col("ITEM_ID") == F.col("_top"))
    pi = F.when(match, F.lit(1 - eps)).otherwise(F.lit(0.0)) + F.lit(eps / n_actions)
    w = pi / F.col("PROPENSITY") if weighted else None
    r = F.col("REWARD")
    dm_row = (1 - eps) * F.coalesce(F.col("_qtop"), F.lit(0.0)) + eps * F.lit(float(q_mean))
    values = {"replay_match": F.avg(F.when(match, r)), "direct_method": F.avg(dm_row), "policy_weighted": F.sum(pi * r) / F.sum(pi)}
    if weighted:
        values |= {"IPS": F.avg(w * r), "SNIPS": F.sum(w * r) / F.sum(w), "DR": F.avg(dm_row) + F.avg(w * (r - F.col("_q")))}
    a = j.agg(*[v.alias(m) for m, v in values.items()])
    return a.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                        for m in ESTIMATORS if m in values])).alias("x")).select("x.*")


NEEDS_PROPENSITY = ("IPS", "SNIPS", "DR")
NEEDS_REWARD_MODEL = ("direct_method", "DR")

#: What a hit at a rank is worth, per metric name; the last two take the reward itself, the others count positives.
GAINS = {
    "precision_at_k": lambda rank, k: F.lit(1.0 / k), "recall_at_k": lambda rank, k: F.lit(1.0),
    "MAP_at_k": lambda rank, k: 1.0 / rank, "MRR_at_k": lambda rank, k: 1.0 / rank,
    "NDCG_at_k": lambda rank, k: 1.0 / F.log2(rank.cast("double") + 1),
    "average_reward_at_k": lambda rank, k: F.lit(1.0 / k), "expected_reward": lambda rank, k: F.lit(1.0),
}
BY_REWARD = ("average_reward_at_k", "expected_reward")


def off_policy_metrics(logged: DataFrame, ranks: DataFrame, evaluator: str, metrics, ks, epsilon: float = 0.1,
                       q: DataFrame | None = None) -> DataFrame:
    """Estimates of ranking metrics under the policy, from logged actions -> (metric, k, value).

    The policy plays one of its top k with (1 - eps) / k each and any of the |A| actions with eps / |A|. An action a
    at rank j <= k is worth ``gain(j) * v`` with v = [reward > 0] (the reward itself for the reward metrics), 0 below k;
    ``expected_reward`` is the reward of any action under k = 1. Then, with w = pi / propensity and value m:

    replay_match avg(m) over rows that the policy would show; IPS avg(w m); SNIPS sum(w m) / sum(w);
    policy_weighted sum(pi m) / sum(pi); direct_method the sum over actions of pi m with the reward model q in place of v;
    DR direct_method + avg(w (m - m_q)). ``ranks`` and ``q`` may be global or per user. One pass over ``logged``.
    """
    need = ["INSTANCE", "ITEM_ID", "REWARD", *(["PROPENSITY"] if evaluator in NEEDS_PROPENSITY else [])]
    missing = [c for c in need if c not in logged.columns]
    if missing:
        raise ValueError(f"off-policy evaluation needs columns {missing} (logged items, rewards, "
                         "logging propensities); use empirical_propensity() to estimate b(a|x)")
    if q is None and evaluator in NEEDS_REWARD_MODEL:
        raise ValueError(f"evaluator {evaluator!r} needs a reward model q (item or pair scores)")
    asked = [(m, int(k)) for m in metrics if m != "expected_reward" for k in ks] + [(m, None) for m in metrics if m == "expected_reward"]
    max_k = max([k for _, k in asked if k] + [1])
    eps = float(epsilon)
    ranks = ranks.filter(F.col("rank") <= max_k)
    who = ["USER_ID"] if "USER_ID" in ranks.columns else []
    own = ["USER_ID"] if q is not None and "USER_ID" in q.columns else []
    j = logged.join(ranks.select(*who, "ITEM_ID", F.col("rank").alias("_rank")), [*who, "ITEM_ID"], "left")
    if q is None:
        actions = logged.select("ITEM_ID").union(ranks.select("ITEM_ID")).distinct().count()
        j = j.withColumns({"_q": F.lit(0.0), "_n": F.lit(actions), "_mean": F.lit(0.0)})
    else:
        j = j.join(q.select(*own, "ITEM_ID", F.col("q").alias("_q")), [*own, "ITEM_ID"], "left").fillna(0.0, ["_q"])
        stats = q.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.avg("q").alias("_mean"))
        if own:
            j = j.join(stats, own, "left").fillna(1, ["_n"]).fillna(0.0, ["_mean"])
        else:
            one = stats.first()   # two scalars
            j = j.withColumns({"_n": F.lit(one["_n"] or 1), "_mean": F.lit(float(one["_mean"] or 0.0))})
    plan = {}

    def play(rank, k):
        return F.when(rank <= k, F.lit((1 - eps) / k)).otherwise(0.0) + F.lit(eps) / F.col("_n")

    if evaluator in NEEDS_REWARD_MODEL:
        # per user (or once): the top-k actions' values under q
        keys = sorted({*who, *own})
        top = ranks.join(q.select(*own, "ITEM_ID", "q"), [*[c for c in own if c in who], "ITEM_ID"], "left").fillna(0.0, ["q"])
        sums = [F.sum(F.when(F.col("rank") <= (k or 1), GAINS[m](F.col("rank"), k or 1) * F.col("q")).otherwise(0.0)).alias(f"_t{i}")
                for i, (m, k) in enumerate(asked)]
        if keys:
            j = j.join(top.groupBy(*keys).agg(*sums), keys, "left")
        else:
            row = top.agg(*sums).first()   # a number a metric
            j = j.withColumns({f"_t{i}": F.lit(float(row[f"_t{i}"] or 0.0)) for i in range(len(asked))})
    for i, (m, k) in enumerate(asked):
        rank, kk = F.col("_rank"), k or 1
        shown = rank.isNotNull() & (rank <= kk)
        v = F.col("REWARD") if m in BY_REWARD else (F.col("REWARD") > 0).cast("double")
        if m == "expected_reward":
            value, model = v, F.col("_q")
        else:
            gain = GAINS[m](rank, kk)
            value, model = F.when(shown, gain * v).otherwise(0.0), F.when(shown, gain * F.col("_q")).otherwise(0.0)
        pi = play(F.coalesce(rank, F.lit(1 << 40)), kk)
        if evaluator == "replay_match":
            plan[i] = F.avg(F.when(shown, value))
        elif evaluator == "policy_weighted":
            plan[i] = F.sum(pi * value) / F.sum(pi)
        elif evaluator in NEEDS_PROPENSITY[:2]:
            w = pi / F.col("PROPENSITY")
            plan[i] = F.avg(w * value) if evaluator == "IPS" else F.sum(w * value) / F.sum(w)
        else:
            t = F.coalesce(F.col(f"_t{i}"), F.lit(0.0))
            dm = (1 - eps) * t + eps * F.col("_mean") if m == "expected_reward" else t * (F.lit((1 - eps) / kk) + F.lit(eps) / F.col("_n"))
            plan[i] = F.avg(dm)
            if evaluator == "DR":
                plan[i] = plan[i] + F.avg(pi / F.col("PROPENSITY") * (value - model))
    a = j.agg(*[c.alias(f"v{i}") for i, c in plan.items()])
    out = [F.struct(F.lit(m).alias("metric"), F.lit(k).cast("long").alias("k"), F.col(f"v{i}").cast("double").alias("value"))
           for i, (m, k) in enumerate(asked)]
    return a.select(F.explode(F.array(*out)).alias("x")).select("x.*")
