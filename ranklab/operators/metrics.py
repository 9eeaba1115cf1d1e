"""Evaluation metrics as relational code.

Inputs are long tables, never a dense (instances x items) matrix:

* ``logged(INSTANCE, USER_ID, ITEM_ID, REWARD)`` - what happened; one row per
  (instance, logged item).
* ``ranks`` - the policy's top-K list, either per user ``(USER_ID, ITEM_ID, rank)``
  or global ``(ITEM_ID, rank)`` for user-independent scorers.

Definitions (means are over *all* instances unless said otherwise):
precision@k = hits/k; recall@k = hits/positives over instances with a positive;
AP@k = sum over hits of (hits up to that rank)/rank, divided by the hits in the
top k; NDCG@k = DCG/IDCG with gain = reward, log2(rank+1) discount, ideal from
the instance's own rewards; MRR@k = 1/rank of the first hit. A logged item is a
hit when its reward is > 0 and it is ranked within k.

All k values are computed from one ranked join (E14), and the result is a
long table ``(metric, k, value)`` (E13).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.operators.ordered import range_pieces, with_running_sums
from ranklab.operators.split import prefix_sums
from ranklab.session import cut_lineage

RANKING_METRICS = ("precision", "recall", "map", "ndcg", "mrr")
NON_K_METRICS = ("roc_auc", "pr_auc", "rmse", "mae", "expected_reward")
K_METRICS = RANKING_METRICS + ("average_reward",)


def _log2(x):
    return F.log2(x.cast("double"))


def logged_per_row(df: DataFrame, instance_cols: Sequence[str] | None, user_col: str = "USER_ID",
                   item_col: str = "ITEM_ID", reward_col: str = "OUTCOME") -> DataFrame:
    """Each row is one instance with one (item, reward); named by ``instance_cols``, or without them by a number of its own."""
    inst = F.monotonically_increasing_id().cast("string") if instance_cols is None else F.concat_ws("|", *[F.col(c).cast("string") for c in instance_cols])
    return df.select(inst.alias("INSTANCE"), F.col(user_col).alias("USER_ID"), F.col(item_col).alias("ITEM_ID"),
                     F.col(reward_col).cast("double").alias("REWARD"))


def logged_wide(df: DataFrame, target_cols: Sequence[str], user_col: str = "USER_ID") -> DataFrame:
    """One instance per user, one entry per ``ITEM_*`` target (item = name after the prefix)."""
    long = df.unpivot([user_col], list(target_cols), "ITEM_ID", "REWARD")
    return long.select(F.col(user_col).alias("INSTANCE"), F.col(user_col).alias("USER_ID"),
                       F.regexp_replace("ITEM_ID", "^ITEM_", "").alias("ITEM_ID"),
                       F.col("REWARD").cast("double").alias("REWARD"))


def logged_per_user(df: DataFrame, user_col: str = "USER_ID", item_col: str = "ITEM_ID",
                    reward_col: str = "OUTCOME") -> DataFrame:
    """One instance per user holding all of that user's logged rows (ragged, no padding)."""
    return df.select(F.col(user_col).alias("INSTANCE"), F.col(user_col).alias("USER_ID"),
                     F.col(item_col).alias("ITEM_ID"), F.col(reward_col).cast("double").alias("REWARD"))


def one_per_item(logged: DataFrame) -> DataFrame:
    """One row per (instance, item) with its best reward: an item that was logged again is still one item."""
    return logged.groupBy("INSTANCE", "USER_ID", "ITEM_ID").agg(F.max("REWARD").alias("REWARD"))


def _attach_ranks(logged: DataFrame, ranks: DataFrame, max_k: int) -> DataFrame:
    ranks = ranks.filter(F.col("rank") <= max_k)
    if "USER_ID" in ranks.columns:
        r = ranks.select("USER_ID", "ITEM_ID", F.col("rank").alias("RANK"))
        return logged.join(r, ["USER_ID", "ITEM_ID"], "left")
    r = ranks.select("ITEM_ID", F.col("rank").alias("RANK"))
    # A global list cut at max_k has max_k rows.
    return logged.join(F.broadcast(r), ["ITEM_ID"], "left")


def ranking_metrics(logged: DataFrame, ranks: DataFrame, ks: Sequence[int],
                    single_item_instances: bool = False) -> DataFrame:
    """Precision, recall, MAP, NDCG, MRR at every k in one pass -> (metric, k, value).

    Repeated rows of an (instance, item) count once, so every value lies in [0, 1] (for rewards >= 0).
    """
    ks = sorted(set(int(k) for k in ks))
    if not single_item_instances:
        logged = one_per_item(logged)
    j = _attach_ranks(logged, ranks, max(ks))
    rel = F.col("REWARD") > 0
    rank = F.col("RANK")
    if single_item_instances:
        # One logged row per instance: no per-instance window is needed.
        per = j.select(
            "INSTANCE", "REWARD", "RANK",
            F.when(rel, F.lit(1)).otherwise(F.lit(0)).alias("_npos"),
            F.when(rel, F.col("REWARD")).otherwise(F.lit(0.0)).alias("_idcg_base"),
        )
        aggs = [F.count(F.lit(1)).alias("_n"), F.sum("_npos").alias("_ninst_pos")]
        for k in ks:
            hit = rel & rank.isNotNull() & (rank <= k)
            aggs += [
                F.sum(F.when(hit, 1.0 / k).otherwise(0.0)).alias(f"precision_{k}"),
                F.sum(F.when(hit, 1.0).otherwise(0.0)).alias(f"recall_{k}"),
                F.sum(F.when(hit, 1.0 / rank).otherwise(0.0)).alias(f"map_{k}"),
                F.sum(F.when(hit & (F.col("_idcg_base") > 0),
                             (F.col("REWARD") / _log2(rank + 1)) / F.col("_idcg_base")).otherwise(0.0)).alias(f"ndcg_{k}"),
                F.sum(F.when(hit, 1.0 / rank).otherwise(0.0)).alias(f"mrr_{k}"),
            ]
        tot = per.agg(*aggs)
    else:
        # Skew-safe general path: nothing below holds more than max(k) rows
        # per instance in one window, whatever an instance's size.
        maxk = max(ks)
        npos = j.groupBy("INSTANCE").agg(F.count_if(rel).alias("_npos"))  # partial aggregation
        # Ideal DCG: the instance's top max(k) positive rewards (WindowGroupLimit prunes per task).
        wi = Window.partitionBy("INSTANCE").orderBy(F.col("REWARD").desc(), F.col("ITEM_ID"))
        ideal = (logged.filter(F.col("REWARD") > 0).withColumn("_ip", F.row_number().over(wi))
                 .filter(F.col("_ip") <= maxk)
                 .groupBy("INSTANCE").agg(*[F.sum(F.when(F.col("_ip") <= k, F.col("REWARD") / _log2(F.col("_ip") + 1))
                                                  .otherwise(0.0)).alias(f"_idcg_{k}") for k in ks]))
        # Ranked rows pre-aggregated to one row per (instance, rank) <= max(k) rows per instance.
        per_rank = (j.filter(rank.isNotNull() & (rank <= maxk)).groupBy("INSTANCE", "RANK")
                    .agg(F.count_if(rel).alias("_h"), F.sum(F.col("REWARD")).alias("_r")))
        wr = Window.partitionBy("INSTANCE").orderBy("RANK").rowsBetween(Window.unboundedPreceding, 0)
        per_rank = per_rank.withColumn("_cum", F.sum("_h").over(wr))
        aggs = []
        for k in ks:
            within = F.col("RANK") <= k
            aggs += [
                F.sum(F.when(within, F.col("_h")).otherwise(0)).alias(f"_hits_{k}"),
                F.sum(F.when(within, F.col("_h") * F.col("_cum") / F.col("RANK")).otherwise(0.0)).alias(f"_apn_{k}"),
                F.sum(F.when(within, F.col("_r") / _log2(F.col("RANK") + 1)).otherwise(0.0)).alias(f"_dcg_{k}"),
                F.min(F.when(within & (F.col("_h") > 0), F.col("RANK"))).alias(f"_first_{k}"),
            ]
        ranked = per_rank.groupBy("INSTANCE").agg(*aggs)
        inst = npos.join(ideal, "INSTANCE", "left").join(ranked, "INSTANCE", "left")
        inst = inst.fillna(0, subset=[f"_hits_{k}" for k in ks]).fillna(
            0.0, subset=[c for k in ks for c in (f"_apn_{k}", f"_dcg_{k}", f"_idcg_{k}")])
        aggs2 = [F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_npos") > 0).alias("_ninst_pos")]
        for k in ks:
            h = F.col(f"_hits_{k}")
            aggs2 += [
                F.sum(h / k).alias(f"precision_{k}"),
                F.sum(F.when(F.col("_npos") > 0, h / F.col("_npos")).otherwise(0.0)).alias(f"recall_{k}"),
                F.sum(F.when(h > 0, F.col(f"_apn_{k}") / h).otherwise(0.0)).alias(f"map_{k}"),
                F.sum(F.when(F.col(f"_idcg_{k}") > 0, F.col(f"_dcg_{k}") / F.col(f"_idcg_{k}")).otherwise(0.0))
                .alias(f"ndcg_{k}"),
                F.sum(F.coalesce(1.0 / F.col(f"_first_{k}"), F.lit(0.0))).alias(f"mrr_{k}"),
            ]
        tot = inst.agg(*aggs2)
    # Turn the one-row sums into means and unpivot to (metric, k, value).
    cols = []
    for k in ks:
        for m in RANKING_METRICS:
            denom = F.col("_ninst_pos") if m == "recall" else F.col("_n")
            cols.append(F.struct(F.lit(m).alias("metric"), F.lit(k).cast("long").alias("k"),
                                 F.when(denom > 0, F.col(f"{m}_{k}") / denom).alias("value")))
    return tot.select(F.explode(F.array(*cols)).alias("r")).select("r.metric", "r.k", "r.value")


def ranking_metrics_by_model(logged: DataFrame, tops: dict, ks: Sequence[int]) -> DataFrame:
    """Single-item instances, several user-independent rankings, ONE pass over ``logged``.

    The models' top-K lists (K rows each) are pivoted into one small table
    ``ITEM_ID -> rank per model`` and broadcast - its size is bounded by the
    sum of the Ks - so evaluating M models costs one scan of the logged rows,
    not M. Output (model_id, metric, k, value); same definitions as
    ``ranking_metrics``.
    """
    ks = sorted(set(int(k) for k in ks))
    names = list(tops)
    long = None
    for name in names:
        t = tops[name].select("ITEM_ID", F.col("rank").cast("long").alias("rank"), F.lit(name).alias("_m"))
        long = t if long is None else long.unionByName(t)
    wide = long.groupBy("ITEM_ID").agg(*[F.max(F.when(F.col("_m") == m, F.col("rank"))).alias(f"_r{i}")
                                         for i, m in enumerate(names)])
    j = logged.join(F.broadcast(wide), "ITEM_ID", "left")
    rel = F.col("REWARD") > 0
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(rel).alias("_npos")]
    for i, _ in enumerate(names):
        rank = F.col(f"_r{i}")
        for k in ks:
            hit = rel & rank.isNotNull() & (rank <= k)
            aggs += [F.count_if(hit).alias(f"h{i}_{k}"),
                     F.sum(F.when(hit, 1.0 / rank).otherwise(0.0)).alias(f"rr{i}_{k}"),
                     F.sum(F.when(hit, 1.0 / _log2(rank + 1)).otherwise(0.0)).alias(f"g{i}_{k}")]
    tot = j.agg(*aggs)
    cols = []
    for i, name in enumerate(names):
        for k in ks:
            n, npos = F.col("_n"), F.col("_npos")
            vals = {"precision": F.col(f"h{i}_{k}") / (n * k), "recall": F.col(f"h{i}_{k}") / npos,
                    "map": F.col(f"rr{i}_{k}") / n, "ndcg": F.col(f"g{i}_{k}") / n, "mrr": F.col(f"rr{i}_{k}") / n}
            for m in RANKING_METRICS:
                denom = npos if m == "recall" else n
                cols.append(F.struct(F.lit(name).alias("model_id"), F.lit(m).alias("metric"),
                                     F.lit(k).cast("long").alias("k"),
                                     F.when(denom > 0, vals[m]).alias("value")))
    return tot.select(F.explode(F.array(*cols)).alias("r")).select("r.*")


def average_reward_at_k(logged: DataFrame, ranks: DataFrame, ks: Sequence[int],
                        single_item_instances: bool = False) -> DataFrame:
    """Mean logged reward of the recommended top-k entries (unlogged entries count 0).

    Per instance: sum of rewards of logged items ranked <= k, divided by k;
    averaged over all instances.
    """
    ks = sorted(set(int(k) for k in ks))
    if not single_item_instances:
        logged = one_per_item(logged)
    j = _attach_ranks(logged, ranks, max(ks))
    aggs = [(F.count(F.lit(1)) if single_item_instances else F.countDistinct("INSTANCE")).alias("_n")]
    for k in ks:
        aggs.append(F.sum(F.when(F.col("RANK") <= k, F.col("REWARD") / k).otherwise(0.0)).alias(f"ar_{k}"))
    tot = j.agg(*aggs)
    cols = [F.struct(F.lit("average_reward").alias("metric"), F.lit(k).cast("long").alias("k"),
                     (F.col(f"ar_{k}") / F.col("_n")).alias("value")) for k in ks]
    return tot.select(F.explode(F.array(*cols)).alias("r")).select("r.metric", "r.k", "r.value")


def expected_reward_global(logged: DataFrame, scores: DataFrame) -> DataFrame:
    """E8c for a user-independent scorer: mean over instances of sum_item softmax(score)(item) * reward.

    The softmax denominator is one global sum over the scored items (computed
    with the max-shift for stability), so no (instance x item) table is built.
    """
    # Two scalars (max, normaliser) come back to the driver; nothing else does.
    mx = scores.agg(F.max("score")).first()[0]
    if mx is None:
        raise ValueError("expected_reward needs a non-empty score table")
    e = F.exp(F.col("score") - F.lit(float(mx)))
    den = scores.agg(F.sum(e)).first()[0]
    pi = scores.select("ITEM_ID", (e / F.lit(float(den))).alias("_pi"))
    j = logged.join(pi, "ITEM_ID", "left")
    per = j.groupBy("INSTANCE").agg(F.sum(F.coalesce(F.col("_pi"), F.lit(0.0)) * F.col("REWARD")).alias("_er"))
    return per.agg(F.avg("_er").alias("value")).select(F.lit("expected_reward").alias("metric"),
                                                        F.lit(None).cast("long").alias("k"), "value")


def expected_reward_pairs(logged: DataFrame, scores: DataFrame) -> DataFrame:
    """E8c for a scorer of (user, item) pairs: softmax over each user's scored items, by partial aggregations per user."""
    top = scores.groupBy("USER_ID").agg(F.max("score").alias("_m"))
    e = scores.join(top, "USER_ID").select("USER_ID", "ITEM_ID", F.exp(F.col("score") - F.col("_m")).alias("_e"))
    total = e.groupBy("USER_ID").agg(F.sum("_e").alias("_t"))
    j = logged.join(e, ["USER_ID", "ITEM_ID"], "left").join(total, "USER_ID", "left")
    per = j.groupBy("INSTANCE").agg(F.sum(F.coalesce(F.col("_e") / F.col("_t"), F.lit(0.0)) * F.col("REWARD")).alias("_er"))
    return per.agg(F.avg("_er").alias("value")).select(F.lit("expected_reward").alias("metric"),
                                                        F.lit(None).cast("long").alias("k"), "value")


def _auc_from_hist(hist: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Tie-aware ROC AUC and step-wise average precision from a per-(group, score) histogram.

    ``hist`` has group columns, ``score``, ``p`` (positives) and ``q``
    (negatives) per distinct score. With cumulative negatives strictly below a
    score (``nb``) and cumulative counts at or above it (``tp``, ``fp``):
    AUC = sum p*(nb + q/2) / (P*N) (Mann-Whitney with average ranks) and
    AP = sum (p/P) * tp/(tp+fp) over distinct thresholds, high to low.
    """
    g = list(group_cols)
    if g:
        # Per group: running sums along the score order from range pieces, so a
        # hot group with many distinct scores is spread over many tasks.
        pieces = range_pieces(hist, g, ["score"])
        h = with_running_sums(pieces, g, ["score"], {"_cp": "p", "_cq": "q"})
        tot = hist.groupBy(*g).agg(F.sum("p").alias("_P"), F.sum("q").alias("_N"))  # one row per group
        h = h.join(tot, g).withColumns({
            "nb": F.col("_cq") - F.col("q"),
            "tp": F.col("_P") - F.col("_cp") + F.col("p"),
            "fp": F.col("_N") - F.col("_cq") + F.col("q")}).drop("_rp", "_cp", "_cq", "_P", "_N")
    else:
        # Global: one distributed pass of prefix sums over the distinct-score
        # table gives positives and negatives strictly below each score; the
        # counts at or above it are the totals minus those.
        tot = hist.agg(F.sum("p"), F.sum("q")).first()  # two scalars
        P, N = int(tot[0] or 0), int(tot[1] or 0)
        h = prefix_sums(hist, ["score"], {"_pb": "p", "nb": "q"})
        h = h.withColumn("tp", F.lit(P) - F.col("_pb")).withColumn("fp", F.lit(N) - F.col("nb"))
    agg = h.groupBy(*g).agg(
        F.sum("p").alias("P"), F.sum("q").alias("N"),
        F.sum(F.col("p") * (F.col("nb") + F.col("q") / 2.0)).alias("_u"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0))
        .alias("_ap"))
    return agg.select(*g,
                      F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_u") / (F.col("P") * F.col("N")))
                      .alias("roc_auc"),
                      F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_ap") / F.col("P")).alias("pr_auc"),
                      F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"))


def classification_metrics(scored: DataFrame, label_col: str = "label", score_col: str = "score",
                           group_cols: Sequence[str] = ()) -> DataFrame:
    """E8d/E8e (and E9/E10 when grouped): ROC AUC and average precision.

    Rows with a null label or score are masked out. A group with one class
    gets NULL (the reference reports NaN). The data are first reduced to one
    row per distinct (group, score) - partial aggregation before any window.
    """
    s = scored.filter(F.col(label_col).isNotNull() & F.col(score_col).isNotNull())
    hist = s.groupBy(*group_cols, F.col(score_col).cast("double").alias("score")).agg(
        F.count_if(F.col(label_col) > 0).alias("p"), F.count_if(F.col(label_col) <= 0).alias("q"))
    # frozen once: the totals, the sort's sampling and the sums read it instead of scoring again
    return _auc_from_hist(cut_lineage(hist), group_cols)


def regression_metrics(scored: DataFrame, label_col: str = "label", score_col: str = "score",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """E8f: rmse and mae (nulls masked)."""
    s = scored.filter(F.col(label_col).isNotNull() & F.col(score_col).isNotNull())
    err = F.col(score_col).cast("double") - F.col(label_col).cast("double")
    return s.groupBy(*group_cols).agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                                      F.count(F.lit(1)).alias("n"))


def per_item_auc(scores: DataFrame, truth: DataFrame, user_col: str = "USER_ID", item_col: str = "ITEM_ID",
                 outcome_col: str = "OUTCOME", score_col: str = "score") -> DataFrame:
    """Per-item ROC/PR AUC on long data.

    Truth is reduced with ``max`` per (user, item) (the reference pivots with
    max), scores likewise; only pairs present on both sides count (the
    reference aligns users and items by intersection and masks nulls).
    """
    t = truth.groupBy(user_col, item_col).agg(F.max(outcome_col).alias("_label"))
    s = scores.groupBy(user_col, item_col).agg(F.max(score_col).alias("_score"))
    j = t.join(s, [user_col, item_col])
    return classification_metrics(j, "_label", "_score", [item_col])


def metric_key(metric: str, k: int | None) -> str:
    """``name@k`` for ranking metrics, bare name otherwise."""
    return f"{metric}@{k}" if k is not None else metric
