"""One place for what the registration modules share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranklab.operators.split import temporal_split, temporal_split_narrow
from ranklab.session import materialize
from ranklab.sources import tables as T


def registry():
    """(queries, oracle SQL, decorator that registers a query under a name with its SQL)."""
    queries, oracle = {}, {}

    def register(name, sql=None):
        def deco(fn):
            queries[name] = fn
            if sql is not None:
                oracle[name] = sql
            return fn
        return deco
    return queries, oracle, register


def r6(c):
    return F.round(F.col(c).cast("double"), 6).alias(c)


def written_interactions(spark, sf_dir, cols=None):
    """The interactions (or ``cols`` of them) written once: a split reads its rows several times, and each reading of the view would shuffle the join again."""
    j = T.interactions(spark, sf_dir)
    return materialize(j.select(*cols) if cols else j, "interactions")


def temporal_parts(spark, sf_dir, valid: float = 0.1, test: float = 0.1, cols=None):
    """(train, valid) of the interactions' temporal split. The joined rows are written once and the split only compares them with its cuts, so train
    is a scan of that table; the small validation part, which metrics read often, is written by itself.

    With ``cols``, what the caller reads, only these and the time go through the join and are written; the few orders that a cut falls among are joined
    again for whole rows."""
    if cols is None:
        s = temporal_split(written_interactions(spark, sf_dir), valid, test, "TIMESTAMP", T.INTER_TIEBREAK)
    else:
        # items as the numbers they are made from, and as text again when read
        stored = dict.fromkeys("l_partkey" if c == "ITEM_ID" else c for c in (*cols, "TIMESTAMP"))
        rows = written_interactions(spark, sf_dir, list(stored))
        rows = rows.select("TIMESTAMP", *[F.col("l_partkey").cast("string").alias(c) if c == "ITEM_ID" else c for c in cols if c != "TIMESTAMP"])
        s = temporal_split_narrow(rows, lambda keep: T.interactions(spark, sf_dir, materialize(T.orders_when(spark, sf_dir, keep), "edge-orders")),
                                  valid, test, "TIMESTAMP", T.INTER_TIEBREAK).select(*cols, "split")
    train, held = (s.filter(F.col("split") == part).drop("split") for part in ("train", "valid"))
    return train, materialize(held, "valid-rows")
