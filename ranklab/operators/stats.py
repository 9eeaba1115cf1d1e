"""Exact order statistics without collecting a column (used by M22 goal values)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.operators.split import cumulative_before


def exact_percentile(df: DataFrame, column: str, p: float) -> float | None:
    """Linear-interpolated percentile (same definition as SQL ``percentile_cont``).

    The column is reduced to a histogram of distinct values (partial
    aggregation), a distributed prefix sum gives each distinct value its
    first position, and only the (at most two) histogram rows that hold
    positions floor(h) and ceil(h), h = (n-1)*p, come back to the driver.
    """
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be in [0, 1]")
    hist = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    hist = cumulative_before(hist, ["v"], weight="c")
    n = hist.agg(F.sum("c")).first()[0]
    if not n:
        return None
    h = (n - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    rows = hist.filter(((F.col("_before") <= lo) & (F.col("_before") + F.col("c") > lo)) |
                       ((F.col("_before") <= hi) & (F.col("_before") + F.col("c") > hi))).select(
        "v", "c", "_before").collect()
    v_at = {}
    for pos in (lo, hi):
        v_at[pos] = next(r["v"] for r in rows if r["_before"] <= pos < r["_before"] + r["c"])
    return v_at[lo] + (h - lo) * (v_at[hi] - v_at[lo])


def goal_values(df: DataFrame, reward_cols, method: str = "mean_scalarization", p: float = 0.5,
                predefined: dict | None = None) -> dict:
    """M22 inference goals for ``OUTCOME_*`` rewards: mean, percentile or predefined."""
    if method == "mean_scalarization":
        row = df.agg(*[F.avg(c).alias(c) for c in reward_cols]).first()
        return {c: row[c] for c in reward_cols}
    if method == "percentile_value":
        return {c: exact_percentile(df, c, p) for c in reward_cols}
    if method == "predefined_value":
        missing = [c for c in reward_cols if c not in (predefined or {})]
        if missing:
            raise ValueError(f"predefined goal values missing for {missing}")
        return {c: float(predefined[c]) for c in reward_cols}
    raise ValueError(f"unknown goal method {method!r}")
