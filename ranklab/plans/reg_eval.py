"""Registered checks: splits, scoring, metrics, leaderboard (X*, M16, E*, L1)."""

from __future__ import annotations

from ranklab.plans import sql_views as V
from ranklab.plans.registering import registry
from ranklab.plans.flagship import flagship

QUERIES, ORACLE, register = registry()


_METRIC_SQL = """
  sum(CASE WHEN reward > 0 AND rank <= 10 THEN CAST(1 AS DOUBLE) / 10 ELSE 0 END) / count(*) AS precision_at_10,
  sum(CASE WHEN reward > 0 AND rank <= 10 THEN CAST(1 AS DOUBLE) ELSE 0 END)
      / sum(CASE WHEN reward > 0 THEN 1 ELSE 0 END) AS recall_at_10,
  sum(CASE WHEN reward > 0 AND rank <= 10 THEN CAST(1 AS DOUBLE) / rank ELSE 0 END) / count(*) AS map_at_10,
  sum(CASE WHEN reward > 0 AND rank <= 10 THEN (reward / log2(rank + 1)) / reward ELSE 0 END) / count(*) AS ndcg_at_10,
  sum(CASE WHEN reward > 0 AND rank <= 10 THEN CAST(1 AS DOUBLE) / rank ELSE 0 END) / count(*) AS mrr_at_10"""

FLAGSHIP_SQL = f"""
WITH {V.INTER},
{V.temporal_split_sql('inter', V.INTER_ORDER)},
scores AS (
  SELECT 'popularity' AS model_id, ITEM_ID, avg(OUTCOME) AS score FROM sp WHERE split = 'train' GROUP BY ITEM_ID
  UNION ALL
  SELECT 'most_interacted', ITEM_ID, CAST(count(*) AS DOUBLE) FROM sp WHERE split = 'train' GROUP BY ITEM_ID),
top AS (
  SELECT * FROM (SELECT model_id, ITEM_ID,
                        row_number() OVER (PARTITION BY model_id ORDER BY score DESC, ITEM_ID) AS rank
                 FROM scores) WHERE rank <= 10),
j AS (
  SELECT m.model_id, v.OUTCOME AS reward, t.rank
  FROM (SELECT * FROM sp WHERE split = 'valid') v
  CROSS JOIN (SELECT DISTINCT model_id FROM scores) m
  LEFT JOIN top t ON t.model_id = m.model_id AND t.ITEM_ID = v.ITEM_ID),
agg AS (SELECT model_id, {_METRIC_SQL} FROM j GROUP BY model_id)
SELECT model_id, round(map_at_10, 6) AS map_at_10, round(mrr_at_10, 6) AS mrr_at_10,
       round(ndcg_at_10, 6) AS ndcg_at_10, round(precision_at_10, 6) AS precision_at_10,
       round(recall_at_10, 6) AS recall_at_10,
       row_number() OVER (ORDER BY ndcg_at_10 DESC NULLS LAST, model_id) AS rank
FROM agg
"""

register("flagship_leaderboard", FLAGSHIP_SQL)(lambda spark, sf: flagship(spark, sf))
