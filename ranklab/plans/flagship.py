"""The minimum end-to-end slice: interactions -> temporal split -> two
user-independent scorers fitted on train -> top-k -> ranking metrics on the
validation rows -> leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.operators import leaderboard as lb
from ranklab.operators import metrics as mt
from ranklab.operators import scoring as sc
from ranklab.plans.registering import temporal_parts
from ranklab.session import materialize


def baseline_results(spark: SparkSession, sf_dir: str, k: int = 10, valid_fraction: float = 0.1,
                     test_fraction: float = 0.1) -> DataFrame:
    """Two user-independent scorers from ONE aggregation over train (mean outcome
    and interaction count per item), evaluated together in ONE pass over the
    validation rows."""
    train, valid = temporal_parts(spark, sf_dir, valid_fraction, test_fraction, ["USER_ID", "ITEM_ID", "OUTCOME"])
    stats = materialize(train.groupBy("ITEM_ID").agg(F.avg("OUTCOME").alias("popularity"),
                                                     F.count(F.lit(1)).cast("double").alias("most_interacted")), "item-means")
    tops = {m: sc.top_k_global(stats.select("ITEM_ID", F.col(m).alias("score")), k)
            for m in ("popularity", "most_interacted")}
    logged = mt.logged_per_row(valid, None)
    return mt.ranking_metrics_by_model(logged, tops, [k])


def flagship(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    res = baseline_results(spark, sf_dir, k)
    keys = [(m, k) for m in mt.RANKING_METRICS]
    board = lb.leaderboard(res, "ndcg", k, keys=keys)
    return board.select("model_id", *[F.round(F.col(lb.metric_column_name(m, k)), 6).alias(lb.metric_column_name(m, k))
                                      for m in mt.RANKING_METRICS],
                        F.col("rank").cast("long").alias("rank"))
