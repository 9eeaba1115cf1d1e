"""Registered checks: metrics over scored tables, off-policy estimators,
top-k, candidate restriction, embeddings, transitions, uplift, goals,
exploration, and conversation audits."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.operators import audit as au
from ranklab.operators import metrics as mt
from ranklab.operators import offpolicy as op
from ranklab.operators import reshape as rs
from ranklab.operators import scoring as sc
from ranklab.operators import split as sp
from ranklab.operators import stats as st
from ranklab.plans import sql_views as V
from ranklab.plans.registering import r6, registry, temporal_parts
from ranklab.session import cut_lineage
from ranklab.session import materialize
from ranklab.sources import tables as T

QUERIES, ORACLE, register = registry()



_SP = f"{V.INTER},\n{V.temporal_split_sql('inter', V.INTER_ORDER)}"
_POP = "pop AS (SELECT ITEM_ID, avg(OUTCOME) AS score FROM sp WHERE split = 'train' GROUP BY ITEM_ID)"


# What the metrics over logged rows read, where a row's key names its instance.
_LOGGED = ["USER_ID", "ITEM_ID", "OUTCOME", *T.INTER_TIEBREAK]


# ------------------------------------------------------------------ ranking metrics, per-user regime

@register("ranking_metrics_per_user", f"""
WITH {_SP}, {_POP},
top AS (SELECT ITEM_ID, row_number() OVER (ORDER BY score DESC, ITEM_ID) AS rank FROM pop QUALIFY rank <= 20),
lg AS (SELECT USER_ID AS inst, ITEM_ID, max(OUTCOME) AS reward FROM sp WHERE split = 'valid' GROUP BY USER_ID, ITEM_ID),
j AS (SELECT lg.*, t.rank FROM lg LEFT JOIN top t USING (ITEM_ID)),
jj AS (SELECT *,
         sum(CASE WHEN reward > 0 AND rank IS NOT NULL THEN 1 ELSE 0 END) OVER (
             PARTITION BY inst ORDER BY rank ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumhit,
         row_number() OVER (PARTITION BY inst ORDER BY reward DESC, ITEM_ID) AS ideal_pos FROM j),
ks AS (SELECT unnest([5, 10, 20]) AS k),
per AS (SELECT inst, k, count_if(reward > 0) AS npos, count_if(reward > 0 AND rank <= k) AS hits,
          sum(CASE WHEN reward > 0 AND rank <= k THEN cumhit / rank ELSE 0 END) AS apn,
          sum(CASE WHEN rank <= k THEN reward / log2(rank + 1) ELSE 0 END) AS dcg,
          sum(CASE WHEN ideal_pos <= k AND reward > 0 THEN reward / log2(ideal_pos + 1) ELSE 0 END) AS idcg,
          min(CASE WHEN reward > 0 AND rank <= k THEN rank END) AS first_
        FROM jj, ks GROUP BY inst, k),
agg AS (SELECT k, sum(hits / k) / count(*) AS precision,
          sum(CASE WHEN npos > 0 THEN hits / npos ELSE 0 END) / count_if(npos > 0) AS recall,
          sum(CASE WHEN hits > 0 THEN apn / hits ELSE 0 END) / count(*) AS map,
          sum(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END) / count(*) AS ndcg,
          sum(coalesce(1 / first_, 0)) / count(*) AS mrr
        FROM per GROUP BY k)
SELECT 'precision' AS metric, CAST(k AS BIGINT) AS k, round(precision, 6) AS value FROM agg
UNION ALL SELECT 'recall', k, round(recall, 6) FROM agg
UNION ALL SELECT 'map', k, round(map, 6) FROM agg
UNION ALL SELECT 'ndcg', k, round(ndcg, 6) FROM agg
UNION ALL SELECT 'mrr', k, round(mrr, 6) FROM agg""")
def q_rank_per_user(spark, sf):
    train, valid = temporal_parts(spark, sf, cols=["USER_ID", "ITEM_ID", "OUTCOME"])
    top = sc.top_k_global(sc.item_mean_scores(train), 20)
    res = mt.ranking_metrics(mt.logged_per_user(valid), top, [5, 10, 20])
    return res.select("metric", "k", r6("value"))


# ------------------------------------------------------------------ classification / regression

_AUC_SQL = """
  SELECT {g} round(sum(p * (nb + q / CAST(2 AS DOUBLE))) / (sum(p) * sum(q)), 6) AS roc_auc,
         round(sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) ELSE 0 END) / sum(p), 6) AS pr_auc,
         CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg
  FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY {pg} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
               sum(p) OVER (PARTITION BY {pg} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(q) OVER (PARTITION BY {pg} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp
        FROM (SELECT {g} score, count_if(label > 0) AS p, count_if(label <= 0) AS q FROM scored
              WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY {g} score))
  {groupby}"""


def _auc_sql(group: str | None, digits: int = 6) -> str:
    if digits != 6:
        return _auc_sql(group).replace(", 6) AS", f", {digits}) AS")
    if group:
        return _AUC_SQL.format(g=f"{group},", pg=group, groupby=f"GROUP BY {group}")
    return _AUC_SQL.format(g="", pg="NULL", groupby="")


@register("classification_auc_popularity", f"""
WITH {_SP}, {_POP},
scored AS (SELECT v.OUTCOME AS label, p.score FROM sp v JOIN pop p USING (ITEM_ID) WHERE v.split = 'valid'),
a AS ({_auc_sql(None)})
SELECT a.*, (SELECT count(*) FROM sp WHERE split = 'valid') AS n_logged FROM a""")
def q_auc(spark, sf):
    train, valid = temporal_parts(spark, sf, cols=["ITEM_ID", "OUTCOME"])
    scored = valid.join(sc.item_mean_scores(train), "ITEM_ID")
    m = mt.classification_metrics(scored, "OUTCOME", "score")
    # n_logged beside n_pos + n_neg tells how many logged rows have no score (cold items)
    return m.select(r6("roc_auc"), r6("pr_auc"), "n_pos", "n_neg", F.lit(valid.count()).cast("long").alias("n_logged"))


@register("per_item_auc_priorities", f"""
WITH {V.PRIO},
t AS (SELECT USER_ID, ITEM_ID, max(OUTCOME) AS label FROM prio GROUP BY USER_ID, ITEM_ID),
s AS (SELECT USER_ID, ITEM_ID, CAST(count(*) AS DOUBLE) AS score FROM prio GROUP BY USER_ID, ITEM_ID),
scored AS (SELECT ITEM_ID, label, score FROM t JOIN s USING (USER_ID, ITEM_ID))
{_auc_sql('ITEM_ID')}""")
def q_per_item_auc(spark, sf):
    prio = T.priorities(spark, sf)
    scores = prio.groupBy("USER_ID", "ITEM_ID").agg(F.count(F.lit(1)).cast("double").alias("score"))
    m = mt.per_item_auc(scores, prio)
    return m.select("ITEM_ID", r6("roc_auc"), r6("pr_auc"), "n_pos", "n_neg")


@register("per_label_auc_labels", f"""
WITH {V.LAB},
scored AS (SELECT 'quality' AS label_name, ITEM_quality AS label, CAST(n_chars AS DOUBLE) AS score FROM lab
           UNION ALL SELECT 'toxic', ITEM_toxic, CAST(n_chars AS DOUBLE) FROM lab),
per AS ({_auc_sql('label_name')})
SELECT * FROM per
UNION ALL
SELECT 'macro', round(avg(roc_auc), 6), round(avg(pr_auc), 6), CAST(sum(n_pos) AS BIGINT), CAST(sum(n_neg) AS BIGINT)
FROM per""")
def q_per_label(spark, sf):
    lab = T.labelled_docs(spark, sf)
    long = lab.unpivot(["USER_ID", "n_chars"], ["ITEM_quality", "ITEM_toxic"], "label_name", "label") \
        .withColumn("label_name", F.regexp_replace("label_name", "^ITEM_", "")) \
        .withColumn("score", F.col("n_chars").cast("double"))
    per = mt.classification_metrics(long, "label", "score", ["label_name"]).select(
        "label_name", r6("roc_auc"), r6("pr_auc"), "n_pos", "n_neg")
    macro = per.agg(F.lit("macro").alias("label_name"), F.round(F.avg("roc_auc"), 6).alias("roc_auc"),
                    F.round(F.avg("pr_auc"), 6).alias("pr_auc"), F.sum("n_pos").cast("long").alias("n_pos"),
                    F.sum("n_neg").cast("long").alias("n_neg"))
    return per.unionByName(macro)


@register("regression_revenue", f"""
WITH {_SP},
m AS (SELECT ITEM_ID, avg(OUTCOME_revenue) AS score FROM sp WHERE split = 'train' GROUP BY ITEM_ID)
SELECT round(sqrt(avg((score - OUTCOME_revenue) * (score - OUTCOME_revenue))), 6) AS rmse,
       round(avg(abs(score - OUTCOME_revenue)), 6) AS mae, count(*) AS n,
       (SELECT count(*) FROM sp WHERE split = 'valid') AS n_logged
FROM sp v JOIN m USING (ITEM_ID) WHERE v.split = 'valid'""")
def q_regression(spark, sf):
    train, valid = temporal_parts(spark, sf, cols=["ITEM_ID", "OUTCOME_revenue"])
    m = train.groupBy("ITEM_ID").agg(F.avg("OUTCOME_revenue").alias("score"))
    r = mt.regression_metrics(valid.join(m, "ITEM_ID"), "OUTCOME_revenue", "score")
    return r.select(r6("rmse"), r6("mae"), "n", F.lit(valid.count()).cast("long").alias("n_logged"))


@register("reward_metrics_popularity", f"""
WITH {_SP}, {_POP},
top AS (SELECT ITEM_ID, row_number() OVER (ORDER BY score DESC, ITEM_ID) AS rank FROM pop QUALIFY rank <= 10),
v AS (SELECT * FROM sp WHERE split = 'valid'),
j AS (SELECT v.OUTCOME AS reward, t.rank FROM v LEFT JOIN top t USING (ITEM_ID)),
mx AS (SELECT max(score) AS m FROM pop),
pi AS (SELECT ITEM_ID, exp(score - (SELECT m FROM mx)) / (SELECT sum(exp(score - (SELECT m FROM mx))) FROM pop) AS pi
       FROM pop)
SELECT 'average_reward@5' AS metric_key,
       round(sum(CASE WHEN rank <= 5 THEN reward / 5 ELSE 0 END) / count(*), 6) AS value FROM j
UNION ALL
SELECT 'average_reward@10', round(sum(CASE WHEN rank <= 10 THEN reward / 10 ELSE 0 END) / count(*), 6) FROM j
UNION ALL
SELECT 'expected_reward', round(avg(coalesce(pi.pi, 0) * v.OUTCOME), 6) FROM v LEFT JOIN pi USING (ITEM_ID)""")
def q_rewards(spark, sf):
    train, valid = temporal_parts(spark, sf, cols=_LOGGED)
    pop = materialize(sc.item_mean_scores(train), "item-means")
    logged = mt.logged_per_row(valid, T.INTER_TIEBREAK)
    a = mt.average_reward_at_k(logged, sc.top_k_global(pop, 10), [5, 10])
    e = mt.expected_reward_global(logged, pop)
    key = F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat_ws("@", "metric", "k"))
    return a.unionByName(e).select(key.alias("metric_key"), r6("value"))


@register("off_policy_popularity", f"""
WITH {_SP},
q AS (SELECT ITEM_ID, avg(OUTCOME) AS q FROM sp WHERE split = 'train' GROUP BY ITEM_ID),
top1 AS (SELECT ITEM_ID, q AS qtop FROM q ORDER BY q DESC, ITEM_ID LIMIT 1),
v AS (SELECT * FROM sp WHERE split = 'valid'),
b AS (SELECT ITEM_ID, count(*) / (SELECT count(*) FROM v) AS prop FROM v GROUP BY ITEM_ID),
na AS (SELECT count(*) AS n_actions, avg(q) AS qmean FROM q),
j AS (SELECT v.OUTCOME AS r, b.prop, coalesce(q.q, 0) AS ql, v.ITEM_ID = (SELECT ITEM_ID FROM top1) AS m
      FROM v JOIN b USING (ITEM_ID) LEFT JOIN q USING (ITEM_ID)),
k AS (SELECT *, (CASE WHEN m THEN CAST(0.9 AS DOUBLE) ELSE 0 END) + CAST(0.1 AS DOUBLE) / (SELECT n_actions FROM na) AS pi,
             CAST(0.9 AS DOUBLE) * (SELECT qtop FROM top1) + CAST(0.1 AS DOUBLE) * (SELECT qmean FROM na) AS dm
      FROM j),
a AS (SELECT avg(CASE WHEN m THEN r END) AS rm, avg(pi / prop * r) AS ips, sum(pi / prop * r) / sum(pi / prop) AS snips,
             avg(dm) AS dmv, avg(dm) + avg(pi / prop * (r - ql)) AS dr, sum(pi * r) / sum(pi) AS pw FROM k)
SELECT 'replay_match' AS metric, round(rm, 6) AS value FROM a
UNION ALL SELECT 'IPS', round(ips, 6) FROM a
UNION ALL SELECT 'SNIPS', round(snips, 6) FROM a
UNION ALL SELECT 'direct_method', round(dmv, 6) FROM a
UNION ALL SELECT 'DR', round(dr, 6) FROM a
UNION ALL SELECT 'policy_weighted', round(pw, 6) FROM a""")
def q_offpolicy(spark, sf):
    train, valid = temporal_parts(spark, sf, cols=["USER_ID", "ITEM_ID", "OUTCOME"])
    q = materialize(sc.item_mean_scores(train), "item-means").withColumnRenamed("score", "q")
    logged = op.empirical_propensity(mt.logged_per_row(valid, None))
    res = op.off_policy_estimates(logged, q, epsilon=0.1)  # greedy on q, ties by item id
    return res.select("metric", r6("value"))


_ESTIMATES = {
    "replay_match": "avg(CASE WHEN shown THEN m END)", "IPS": "avg(pi / prop * m)", "SNIPS": "sum(pi / prop * m) / sum(pi / prop)",
    "policy_weighted": "sum(pi * m) / sum(pi)", "direct_method": "avg(dm)", "DR": "avg(dm) + avg(pi / prop * (m - mq))"}


@register("off_policy_at_k_popularity", f"""
WITH {_SP}, {_POP},
top AS (SELECT ITEM_ID, score AS q, row_number() OVER (ORDER BY score DESC, ITEM_ID) AS rank FROM pop QUALIFY rank <= 200),
v AS (SELECT * FROM sp WHERE split = 'valid'),
b AS (SELECT ITEM_ID, count(*) / (SELECT count(*) FROM v) AS prop FROM v GROUP BY ITEM_ID),
n AS (SELECT CAST(0.1 AS DOUBLE) / count(*) AS explore FROM pop),
ks AS (SELECT unnest([20, 200]) AS k),
g AS (SELECT 'NDCG_at_k' AS metric, rank, 1 / log2(rank + 1) AS gain, k, q FROM top, ks WHERE rank <= k
      UNION ALL SELECT 'precision_at_k', rank, CAST(1 AS DOUBLE) / k, k, q FROM top, ks WHERE rank <= k),
d AS (SELECT metric, k, sum(gain * q) * (CAST(0.9 AS DOUBLE) / k + (SELECT explore FROM n)) AS dm FROM g GROUP BY metric, k),
j AS (SELECT d.metric, d.k, d.dm, b.prop, g.rank IS NOT NULL AS shown,
        CASE WHEN g.rank IS NOT NULL AND v.OUTCOME > 0 THEN gain ELSE 0 END AS m, coalesce(gain * t.q, 0) AS mq,
        CASE WHEN g.rank IS NOT NULL THEN CAST(0.9 AS DOUBLE) / d.k ELSE 0 END + (SELECT explore FROM n) AS pi
      FROM v JOIN b USING (ITEM_ID) CROSS JOIN d LEFT JOIN top t USING (ITEM_ID)
        LEFT JOIN g ON g.metric = d.metric AND g.k = d.k AND g.rank = t.rank)
""" + " UNION ALL ".join(f"SELECT '{e}' AS evaluator, CASE metric WHEN 'NDCG_at_k' THEN 'ndcg' ELSE 'precision' END AS metric, "
                         f"CAST(k AS BIGINT) AS k, round({x}, 6) AS value FROM j GROUP BY metric, k" for e, x in _ESTIMATES.items()))
def q_offpolicy_at_k(spark, sf):
    """E16-E21 through the evaluation driver: every estimator at two ks."""
    from ranklab.plans import evaluate as ev
    train, valid = temporal_parts(spark, sf, cols=_LOGGED)
    pop = cut_lineage(sc.item_mean_scores(train))
    logged = cut_lineage(op.empirical_propensity(mt.logged_per_row(valid, T.INTER_TIEBREAK)))
    scores = ev.Scores(topk=sc.top_k_global(pop, 200), item_scores=pop)
    parts = [ev.evaluate("popularity", scores, logged, e, ["NDCG_at_k", "precision_at_k"], [20, 200]).withColumn("evaluator", F.lit(e))
             for e in _ESTIMATES]
    return reduce(DataFrame.unionByName, parts).select("evaluator", "metric", "k", r6("value"))


@register("evaluate_per_label_labels", f"""
WITH {V.LAB},
scored AS (SELECT 'quality' AS label_name, ITEM_quality AS label, CAST(n_chars AS DOUBLE) AS score FROM lab
           UNION ALL SELECT 'toxic', ITEM_toxic, CAST(n_chars AS DOUBLE) FROM lab),
per AS ({_auc_sql('label_name', 15)})
SELECT 'roc_auc' AS metric, label_name AS label, round(roc_auc, 6) AS value FROM per
UNION ALL SELECT 'pr_auc', label_name, round(pr_auc, 6) FROM per
UNION ALL SELECT 'roc_auc', NULL, round(avg(roc_auc), 6) FROM per
UNION ALL SELECT 'pr_auc', NULL, round(avg(pr_auc), 6) FROM per
UNION ALL SELECT 'rmse', label_name, round(sqrt(avg((score - label) * (score - label))), 6) FROM scored GROUP BY label_name
UNION ALL SELECT 'rmse', NULL, round(avg(x), 6) FROM (SELECT sqrt(avg((score - label) * (score - label))) AS x FROM scored GROUP BY label_name)""")
def q_eval_per_label(spark, sf):
    """E10 through the evaluation driver: per-label values and their mean, the logged table built from the wide slice."""
    from ranklab.plans import evaluate as ev
    lab = T.labelled_docs(spark, sf)
    pairs = lab.select("USER_ID", F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("ITEM_ID"), F.col("n_chars").cast("double").alias("score"))
    res = ev.evaluate("length", ev.Scores(pair_scores=pairs), metrics=["roc_auc", "pr_auc", "rmse"], contract="wide_multioutput",
                      per_label=True, frame=lab)
    return res.select("metric", "label", r6("value"))


@register("evaluate_per_item_priorities", f"""
WITH {V.PRIO},
scored AS (SELECT p.ITEM_ID, p.OUTCOME AS label, CAST(s.n AS DOUBLE) AS score FROM prio p
           JOIN (SELECT USER_ID, ITEM_ID, count(*) AS n FROM prio GROUP BY USER_ID, ITEM_ID) s USING (USER_ID, ITEM_ID)),
per AS ({_auc_sql('ITEM_ID', 15)})
SELECT 'roc_auc' AS metric, ITEM_ID AS label, round(roc_auc, 6) AS value FROM per UNION ALL SELECT 'roc_auc', NULL, round(avg(roc_auc), 6) FROM per""")
def q_eval_per_item(spark, sf):
    """E9/E10 on long data through the evaluation driver."""
    from ranklab.plans import evaluate as ev
    prio = T.priorities(spark, sf)
    pairs = prio.groupBy("USER_ID", "ITEM_ID").agg(F.count(F.lit(1)).cast("double").alias("score"))
    res = ev.evaluate("history", ev.Scores(pair_scores=pairs), metrics=["roc_auc"], per_label=True, frame=prio)
    return res.select("metric", "label", r6("value"))


@register("evaluate_depths_popularity", f"""
WITH {_SP}, {_POP},
top AS (SELECT ITEM_ID, row_number() OVER (ORDER BY score DESC, ITEM_ID) AS rank FROM pop QUALIFY rank <= 500),
j AS (SELECT v.OUTCOME AS reward, t.rank FROM sp v LEFT JOIN top t USING (ITEM_ID) WHERE v.split = 'valid')
SELECT CAST(d AS BIGINT) AS depth, CAST(500 AS BIGINT) AS k,
       round(count_if(reward > 0 AND rank <= d) / count_if(reward > 0), 6) AS value
FROM j, (SELECT unnest([10, 500]) AS d) GROUP BY d""")
def q_eval_depths(spark, sf):
    """Two evaluations of one model through one cache; the deeper list is not served from the shorter one."""
    from ranklab.plans import evaluate as ev
    train, valid = temporal_parts(spark, sf, cols=_LOGGED)
    pop = cut_lineage(sc.item_mean_scores(train))
    logged = cut_lineage(mt.logged_per_row(valid, T.INTER_TIEBREAK))
    with ev.ScoreCache() as cache:
        parts = [ev.evaluate("popularity", ev.Scores(topk=sc.top_k_global(pop, d)), logged, metrics=["recall_at_k"], k_values=[500],
                             single_item_instances=True, cache=cache).select(F.lit(d).cast("long").alias("depth"), "k", r6("value"))
                 for d in (10, 500)]
        return cut_lineage(parts[0].unionByName(parts[1]))


# ------------------------------------------------------------------ scoring

_HIST = "hist AS (SELECT USER_ID, ITEM_ID, CAST(count(*) AS DOUBLE) AS score FROM inter GROUP BY USER_ID, ITEM_ID)"


@register("topk_per_user_history", f"""
WITH {V.INTER}, {_HIST}
SELECT USER_ID, ITEM_ID, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY USER_ID ORDER BY score DESC, ITEM_ID) AS rank FROM hist)
WHERE rank <= 3""")
def q_topk_user(spark, sf):
    inter = T.interactions(spark, sf)
    scores = inter.groupBy("USER_ID", "ITEM_ID").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return sc.top_k_per_user(scores, 3).withColumn("rank", F.col("rank").cast("long"))


@register("topk_candidates_small_parts", f"""
WITH {V.INTER}, {_HIST}
SELECT USER_ID, ITEM_ID, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY USER_ID ORDER BY score DESC, ITEM_ID) AS rank FROM hist
  WHERE ITEM_ID IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 10))
WHERE rank <= 3""")
def q_topk_candidates(spark, sf):
    inter = T.interactions(spark, sf)
    scores = inter.groupBy("USER_ID", "ITEM_ID").agg(F.count(F.lit(1)).cast("double").alias("score"))
    cands = T.items(spark, sf).filter(F.col("size") <= 10).select("ITEM_ID")
    return sc.top_k_per_user(sc.restrict_candidates(scores, cands), 3).withColumn("rank", F.col("rank").cast("long"))


@register("embedding_centroid_top5", """
WITH ex AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM ex GROUP BY label, i),
s AS (SELECT ex.vec_id, ex.label, sum(CAST(ex.x AS DOUBLE) * c.m) AS score FROM ex JOIN c USING (label, i)
      GROUP BY ex.vec_id, ex.label)
SELECT label, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5""")
def q_embeddings(spark, sf):
    s = sc.centroid_scores(T.table(spark, sf, "embeddings"))
    top = sc.top_k_per_user(s, 5, user_col="label", item_col="vec_id")
    return top.select("label", "vec_id", r6("score"), F.col("rank").cast("long"))


@register("transitions_events", f"""
WITH {V.EV},
r AS (SELECT *, lead(ITEM_ID) OVER (PARTITION BY USER_ID ORDER BY "TIMESTAMP", event_id) AS nxt FROM ev),
p AS (SELECT ITEM_ID AS prev_item, nxt AS next_item, count(*) AS n FROM r WHERE nxt IS NOT NULL GROUP BY ITEM_ID, nxt)
SELECT prev_item, next_item, n, round(n / sum(n) OVER (PARTITION BY prev_item), 6) AS prob FROM p""")
def q_transitions(spark, sf):
    t = sc.transition_scores(T.events(spark, sf), order_cols=("TIMESTAMP", "event_id"))
    return t.select("prev_item", "next_item", "n", r6("prob"))


@register("transitions_order2_events", f"""
WITH {V.EV},
r AS (SELECT ITEM_ID AS x, lag(ITEM_ID) OVER w AS p1, lag(ITEM_ID, 2) OVER w AS p2 FROM ev WHERE ITEM_ID IS NOT NULL
      WINDOW w AS (PARTITION BY USER_ID ORDER BY "TIMESTAMP", event_id)),
c0 AS (SELECT x, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM r GROUP BY x),
c1 AS (SELECT p1, x, count(*) AS n, sum(count(*)) OVER (PARTITION BY p1) AS t, count(*) OVER (PARTITION BY p1) AS d FROM r WHERE p1 IS NOT NULL GROUP BY p1, x),
c2 AS (SELECT p2, p1, x, count(*) AS n, sum(count(*)) OVER (PARTITION BY p2, p1) AS t, count(*) OVER (PARTITION BY p2, p1) AS d
       FROM r WHERE p2 IS NOT NULL GROUP BY p2, p1, x)
SELECT c2.p2 AS prev_prev_item, c2.p1 AS prev_item, c2.x AS next_item, CAST(c2.n AS BIGINT) AS n,
       round((c2.n + c2.d * ((c1.n + c1.d * c0.p) / (c1.t + c1.d))) / (c2.t + c2.d), 6) AS prob
FROM c2 JOIN c1 ON c1.p1 = c2.p1 AND c1.x = c2.x JOIN c0 ON c0.x = c2.x""")
def q_transitions_order2(spark, sf):
    """What follows two events, interpolated with what follows one and none."""
    counts = materialize(sc.context_counts(T.events(spark, sf), 2, order_cols=("TIMESTAMP", "event_id")), "contexts")
    s = sc.context_scores(counts, 2)
    return s.select(F.col("context")[0].alias("prev_prev_item"), F.col("context")[1].alias("prev_item"), "next_item", "n", r6("prob"))


@register("embedding_catalogue_top5", """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
           FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND len(q.embedding) > 0 AND len(v.embedding) > 0)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def q_catalogue(spark, sf):
    """The five vectors of the whole table with the highest dot product, for every vector."""
    e = T.table(spark, sf, "embeddings")
    top = sc.catalogue_top_k(e.withColumnRenamed("vec_id", "query_id"), e, 5, "query_id", "vec_id", same=False)
    return top.select("query_id", "vec_id", r6("score"), F.col("rank").cast("long").alias("rank"))


@register("session_transitions_events", f"""
WITH {V.EV},
s1 AS (SELECT *, CASE WHEN "TIMESTAMP" - lag("TIMESTAMP") OVER (PARTITION BY USER_ID ORDER BY "TIMESTAMP", event_id)
                      > 3600000000 THEN 1 ELSE 0 END AS new_ FROM ev),
s2 AS (SELECT *, sum(new_) OVER (PARTITION BY USER_ID ORDER BY "TIMESTAMP", event_id ROWS UNBOUNDED PRECEDING) AS sid
       FROM s1),
r AS (SELECT *, lead(ITEM_ID) OVER (PARTITION BY USER_ID, sid ORDER BY "TIMESTAMP", event_id) AS nxt FROM s2),
p AS (SELECT ITEM_ID AS prev_item, nxt AS next_item, count(*) AS n FROM r WHERE nxt IS NOT NULL GROUP BY ITEM_ID, nxt)
SELECT prev_item, next_item, n, round(n / sum(n) OVER (PARTITION BY prev_item), 6) AS prob FROM p""")
def q_session_transitions(spark, sf):
    ev = rs.assign_sessions(T.events(spark, sf), "USER_ID", "TIMESTAMP", 3_600_000_000, "SESSION_ID", ["event_id"])
    t = sc.transition_scores(ev, order_cols=("TIMESTAMP", "event_id"), session_col="SESSION_ID")
    return t.select("prev_item", "next_item", "n", r6("prob"))


@register("uplift_by_segment", f"""
WITH {V.INTER}, {V.USERS},
j AS (SELECT segment, l_quantity >= 25 AS t, OUTCOME FROM inter JOIN users USING (USER_ID))
SELECT segment, round(avg(CASE WHEN t THEN OUTCOME END), 6) AS mean_treated,
       round(avg(CASE WHEN NOT t THEN OUTCOME END), 6) AS mean_control,
       CAST(count_if(t) AS BIGINT) AS n_treated, CAST(count_if(NOT t) AS BIGINT) AS n_control,
       round(avg(CASE WHEN t THEN OUTCOME END) - avg(CASE WHEN NOT t THEN OUTCOME END), 6) AS uplift
FROM j GROUP BY segment""")
def q_uplift(spark, sf):
    j = T.interactions(spark, sf).join(T.users(spark, sf), "USER_ID").withColumn("t", F.col("l_quantity") >= 25)
    u = sc.observed_uplift(j, "segment", "t")
    return u.select("segment", r6("mean_treated"), r6("mean_control"), "n_treated", "n_control", r6("uplift"))


@register("goal_values_revenue", f"""
WITH {V.INTER}
SELECT 'mean_scalarization' AS method, round(avg(OUTCOME_revenue), 6) AS goal FROM inter
UNION ALL SELECT 'percentile_value', round(quantile_cont(OUTCOME_revenue, 0.9), 6) FROM inter
UNION ALL SELECT 'predefined_value', CAST(1000 AS DOUBLE)""")
def q_goals(spark, sf):
    inter = T.interactions(spark, sf).select("OUTCOME_revenue")
    mean = inter.agg(F.lit("mean_scalarization").alias("method"), F.round(F.avg("OUTCOME_revenue"), 6).alias("goal"))
    p90 = st.exact_percentile(inter, "OUTCOME_revenue", 0.9)
    rest = inter.sparkSession.createDataFrame(
        [("percentile_value", round(p90, 6)), ("predefined_value", st.goal_values(
            inter, ["OUTCOME_revenue"], "predefined_value", predefined={"OUTCOME_revenue": 1000})["OUTCOME_revenue"])],
        "method string, goal double")
    return mean.unionByName(rest)


@register("epsilon_greedy_choice", f"""
WITH {V.INTER}, {_HIST},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY USER_ID ORDER BY score DESC, ITEM_ID) AS rank FROM hist)
        WHERE rank <= 3),
u AS (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', '11', USER_ID)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u,
             max(rank) OVER (PARTITION BY USER_ID) AS kk FROM top),
c AS (SELECT *, u < CAST(0.3 AS DOUBLE) AS explored,
             CASE WHEN u < CAST(0.3 AS DOUBLE) THEN 1 + floor(u / CAST(0.3 AS DOUBLE) * kk) ELSE 1 END AS target FROM u)
SELECT USER_ID, ITEM_ID, rank AS chosen_rank, explored,
       round(CASE WHEN rank = 1 THEN (1 - CAST(0.3 AS DOUBLE)) + CAST(0.3 AS DOUBLE) / kk ELSE CAST(0.3 AS DOUBLE) / kk END, 6)
         AS propensity
FROM c WHERE rank = target""")
def q_eps(spark, sf):
    inter = T.interactions(spark, sf)
    scores = inter.groupBy("USER_ID", "ITEM_ID").agg(F.count(F.lit(1)).cast("double").alias("score"))
    top = sc.top_k_per_user(scores, 3).withColumn("rank", F.col("rank").cast("long"))
    ch = sc.epsilon_greedy(top, 0.3, 11)
    return ch.select("USER_ID", "ITEM_ID", F.col("chosen_rank").cast("long"), "explored", r6("propensity"))


# ------------------------------------------------------------------ audits

_URL = "regexp_replace(u, '" + au.URL_TRAILING_RX.replace("'", "''") + "', '')"


@register("novel_urls_conversations", f"""
WITH urls AS (SELECT conv_id, turn, role, {_URL} AS url
              FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '{au.URL_PATTERN}', 0)) AS u
                    FROM conversations)),
said AS (SELECT DISTINCT conv_id, turn, url FROM urls WHERE role = 'assistant'),
nov AS (SELECT conv_id, count(*) AS n FROM said s WHERE NOT EXISTS (
          SELECT 1 FROM urls t WHERE t.role = 'user' AND t.conv_id = s.conv_id AND t.url = s.url AND t.turn <= s.turn)
        GROUP BY conv_id),
nu AS (SELECT conv_id, count(*) AS n FROM urls GROUP BY conv_id)
SELECT c.conv_id, CAST(count_if(c.role = 'assistant') AS BIGINT) AS n_assistant_turns,
       coalesce(any_value(nu.n), 0) AS n_urls, coalesce(any_value(nov.n), 0) AS n_novel_urls
FROM conversations c LEFT JOIN nu USING (conv_id) LEFT JOIN nov USING (conv_id) GROUP BY c.conv_id""")
def q_urls(spark, sf):
    return au.novel_url_counts(T.table(spark, sf, "conversations"))


def _stdlib_sql_list():
    names = sorted(set(getattr(sys, "stdlib_module_names", ())) | set(au.DEFAULT_TRUSTED))
    return ", ".join("'" + n + "'" for n in names)


_ALIAS_RX = "(?:^|[^A-Za-z0-9_.])(" + "|".join(au.COMMON_ALIASES) + r")\."
_ALIAS_CASE = "CASE " + " ".join(f"WHEN a = '{k}' THEN '{v}'" for k, v in au.COMMON_ALIASES.items()) + " END"


@register("foreign_packages_conversations", f"""
WITH blocks AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{au.FENCE_PATTERN}', 1)) AS block
                FROM conversations),
imp AS (SELECT conv_id, turn, unnest(regexp_extract_all(block, '{au.IMPORT_PATTERN}', 1)) AS package FROM blocks),
ali AS (SELECT conv_id, turn, {_ALIAS_CASE} AS package FROM (
          SELECT conv_id, turn, unnest(regexp_extract_all(block, '{_ALIAS_RX}', 1)) AS a FROM blocks)),
f AS (SELECT DISTINCT conv_id, turn, package FROM (SELECT * FROM imp UNION ALL SELECT * FROM ali)
      WHERE package NOT IN ({_stdlib_sql_list()})),
fc AS (SELECT conv_id, count(DISTINCT package) AS n FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(count_if(len(regexp_extract_all(c.text, '{au.FENCE_PATTERN}', 1)) > 0) AS BIGINT) AS n_code_messages,
       coalesce(any_value(fc.n), 0) AS n_foreign_packages
FROM conversations c LEFT JOIN fc USING (conv_id) GROUP BY c.conv_id""")
def q_foreign(spark, sf):
    return au.foreign_reference_counts(T.table(spark, sf, "conversations"))


# ------------------------------------------------------------------ wide regime, propensities

@register("ranking_metrics_wide_labels", f"""
WITH {V.LAB},
lg AS (SELECT USER_ID AS inst, 'quality' AS ITEM_ID, ITEM_quality AS reward FROM lab
       UNION ALL SELECT USER_ID, 'toxic', ITEM_toxic FROM lab),
pop AS (SELECT ITEM_ID, avg(reward) AS score FROM lg GROUP BY ITEM_ID),
top AS (SELECT ITEM_ID, row_number() OVER (ORDER BY score DESC, ITEM_ID) AS rank FROM pop),
j AS (SELECT lg.*, t.rank FROM lg LEFT JOIN top t USING (ITEM_ID)),
jj AS (SELECT *, sum(CASE WHEN reward > 0 THEN 1 ELSE 0 END) OVER (
             PARTITION BY inst ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumhit,
          row_number() OVER (PARTITION BY inst ORDER BY reward DESC, ITEM_ID) AS ideal_pos FROM j),
ks AS (SELECT unnest([1, 2]) AS k),
per AS (SELECT inst, k, count_if(reward > 0) AS npos, count_if(reward > 0 AND rank <= k) AS hits,
          sum(CASE WHEN reward > 0 AND rank <= k THEN cumhit / rank ELSE 0 END) AS apn,
          sum(CASE WHEN rank <= k THEN reward / log2(rank + 1) ELSE 0 END) AS dcg,
          sum(CASE WHEN ideal_pos <= k AND reward > 0 THEN reward / log2(ideal_pos + 1) ELSE 0 END) AS idcg,
          min(CASE WHEN reward > 0 AND rank <= k THEN rank END) AS first_
        FROM jj, ks GROUP BY inst, k),
agg AS (SELECT k, sum(hits / k) / count(*) AS precision,
          sum(CASE WHEN npos > 0 THEN hits / npos ELSE 0 END) / count_if(npos > 0) AS recall,
          sum(CASE WHEN hits > 0 THEN apn / hits ELSE 0 END) / count(*) AS map,
          sum(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END) / count(*) AS ndcg,
          sum(coalesce(1 / first_, 0)) / count(*) AS mrr
        FROM per GROUP BY k)
SELECT 'precision' AS metric, CAST(k AS BIGINT) AS k, round(precision, 6) AS value FROM agg
UNION ALL SELECT 'recall', k, round(recall, 6) FROM agg
UNION ALL SELECT 'map', k, round(map, 6) FROM agg
UNION ALL SELECT 'ndcg', k, round(ndcg, 6) FROM agg
UNION ALL SELECT 'mrr', k, round(mrr, 6) FROM agg""")
def q_rank_wide(spark, sf):
    lab = T.labelled_docs(spark, sf)
    logged = mt.logged_wide(lab, ["ITEM_quality", "ITEM_toxic"])
    pop = logged.groupBy("ITEM_ID").agg(F.avg("REWARD").alias("score"))
    res = mt.ranking_metrics(logged, sc.top_k_global(pop, 2), [1, 2])
    return res.select("metric", "k", r6("value"))


@register("empirical_propensity_by_segment", f"""
WITH {V.INTER}, {V.USERS},
j AS (SELECT segment, ITEM_ID FROM inter JOIN users USING (USER_ID)),
c AS (SELECT segment, ITEM_ID, count(*) AS n FROM j GROUP BY segment, ITEM_ID)
SELECT segment, count(*) AS n_actions, round(max(n / s), 6) AS max_propensity, round(sum(n / s), 6) AS total
FROM (SELECT *, sum(n) OVER (PARTITION BY segment) AS s FROM c) GROUP BY segment""")
def q_propensity(spark, sf):
    j = T.interactions(spark, sf).join(T.users(spark, sf), "USER_ID").select("segment", "ITEM_ID")
    p = op.empirical_propensity(j, ["segment"]).select("segment", "ITEM_ID", "PROPENSITY").distinct()
    return p.groupBy("segment").agg(F.count(F.lit(1)).alias("n_actions"),
                                    F.round(F.max("PROPENSITY"), 6).alias("max_propensity"),
                                    F.round(F.sum("PROPENSITY"), 6).alias("total"))


@register("evaluate_driver_popularity", f"""
WITH {_SP}, {_POP},
top AS (SELECT ITEM_ID, row_number() OVER (ORDER BY score DESC, ITEM_ID) AS rank FROM pop QUALIFY rank <= 10),
v AS (SELECT * FROM sp WHERE split = 'valid'),
j AS (SELECT v.OUTCOME AS reward, t.rank FROM v LEFT JOIN top t USING (ITEM_ID)),
m AS (SELECT
  sum(CASE WHEN reward > 0 AND rank <= 5 THEN CAST(1 AS DOUBLE) / 5 ELSE 0 END) / count(*) AS p5,
  sum(CASE WHEN reward > 0 AND rank <= 10 THEN CAST(1 AS DOUBLE) / 10 ELSE 0 END) / count(*) AS p10,
  sum(CASE WHEN reward > 0 AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) / count(*) AS n5,
  sum(CASE WHEN reward > 0 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / count(*) AS n10 FROM j),
scored AS (SELECT v.OUTCOME AS label, p.score FROM v JOIN pop p USING (ITEM_ID)),
auc AS ({_auc_sql(None)}),
pi AS (SELECT ITEM_ID, exp(score - (SELECT max(score) FROM pop))
                       / (SELECT sum(exp(score - (SELECT max(score) FROM pop))) FROM pop) AS pi FROM pop)
SELECT 'popularity' AS model_id, 'precision@5' AS metric_key, round(p5, 6) AS value FROM m
UNION ALL SELECT 'popularity', 'precision@10', round(p10, 6) FROM m
UNION ALL SELECT 'popularity', 'ndcg@5', round(n5, 6) FROM m
UNION ALL SELECT 'popularity', 'ndcg@10', round(n10, 6) FROM m
UNION ALL SELECT 'popularity', 'roc_auc', roc_auc FROM auc
UNION ALL SELECT 'popularity', 'expected_reward', round(avg(coalesce(pi.pi, 0) * v.OUTCOME), 6)
          FROM v LEFT JOIN pi USING (ITEM_ID)""")
def q_eval_driver(spark, sf):
    """E13-E15, E23 through the evaluation driver: one long result table keyed name@k."""
    from ranklab.plans import evaluate as ev
    train, valid = temporal_parts(spark, sf, cols=_LOGGED)
    pop = materialize(sc.item_mean_scores(train), "item-means")
    logged = mt.logged_per_row(valid, T.INTER_TIEBREAK)
    pairs = valid.select("USER_ID", "ITEM_ID").distinct().join(pop, "ITEM_ID")  # scores of the logged pairs only
    res = ev.evaluate("popularity", ev.Scores(topk=sc.top_k_global(pop, 10), pair_scores=pairs, item_scores=pop),
                      logged, metrics=["NDCG_at_k", "precision_at_k", "roc_auc", "expected_reward"], k_values=[5, 10],
                      single_item_instances=True)
    key = F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat_ws("@", "metric", F.col("k").cast("string")))
    return res.select("model_id", key.alias("metric_key"), r6("value"))
