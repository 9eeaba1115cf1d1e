"""Per-group ordered operations that never put one whole group in one task.

Previous / next row and running sums along each group's order (a user's
events in time) are the basis of sessionization and next-item transitions.
A plain ``Window.partitionBy(user)`` puts a user's whole history in one
task; here the rows are range-partitioned on (group, order) instead, so a
group larger than a partition is cut into *pieces* across several
partitions. That partitioning is frozen with a reliable checkpoint. Inside a
piece a window does the work. The rows at piece boundaries get their
neighbour from the adjacent piece, and running sums get the totals of the
earlier pieces, through a small per-piece table whose window per group
holds at most one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.session import cut_lineage


def range_pieces(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                 n_partitions: int | None = None) -> DataFrame:
    """Range-partition on (group, order), tag each row with its partition (``_rp``), freeze."""
    n = n_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *[F.col(c) for c in [*group_cols, *order_cols]])
    return cut_lineage(s.withColumn("_rp", F.spark_partition_id()))


def with_neighbors(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                   value_cols: Sequence[str], direction: str = "prev", prefix: str | None = None,
                   pieces: DataFrame | None = None) -> DataFrame:
    """Add ``<prefix><v>``: the value of the previous (``prev``) or next (``next``)
    row of the same group in ``order_cols`` order (null at the group's edge).

    ``pieces`` may pass an already range-partitioned frame (from ``range_pieces``);
    the result keeps its ``_rp`` column for further piecewise steps.
    """
    if direction not in ("prev", "next"):
        raise ValueError("direction must be 'prev' or 'next'")
    prefix = prefix or f"_{direction}_"
    s = pieces if pieces is not None else range_pieces(df, group_cols, order_cols)
    order = [F.col(c) for c in order_cols]
    w = Window.partitionBy("_rp", *group_cols).orderBy(*order)
    step = F.lag if direction == "prev" else F.lead
    s = s.withColumns({prefix + v: step(F.col(v)).over(w) for v in value_cols})
    s = s.withColumn("_edge", step(F.lit(1)).over(w).isNull())  # first (prev) / last (next) row of the piece
    key = F.struct(*order)
    vals = F.struct(*[F.col(v) for v in value_cols])
    per_piece = s.groupBy("_rp", *group_cols).agg(F.max_by(vals, key).alias("_last"), F.min_by(vals, key).alias("_first"))
    wp = Window.partitionBy(*group_cols).orderBy("_rp")  # at most one row per partition per group
    nb = F.lag("_last").over(wp) if direction == "prev" else F.lead("_first").over(wp)
    per_piece = per_piece.select("_rp", *group_cols, nb.alias("_nb"))
    out = s.join(per_piece, ["_rp", *group_cols], "left")
    out = out.withColumns({prefix + v: F.when(F.col("_edge"), F.col("_nb")[v]).otherwise(F.col(prefix + v))
                           for v in value_cols})
    return out.drop("_edge", "_nb")


def with_running_sums(s: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], sums: dict) -> DataFrame:
    """Inclusive running sums ``out -> value column`` along each group's order, on
    a frame that carries ``_rp`` from ``range_pieces``: in-piece running sums
    plus the totals of the group's earlier pieces (one per-piece table, one join)."""
    order = [F.col(c) for c in order_cols]
    names = list(sums)
    w = Window.partitionBy("_rp", *group_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({f"_loc{i}": F.sum(sums[n]).over(w) for i, n in enumerate(names)})
    per_piece = s.groupBy("_rp", *group_cols).agg(*[F.sum(sums[n]).alias(f"_pt{i}") for i, n in enumerate(names)])
    wp = Window.partitionBy(*group_cols).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    per_piece = per_piece.select("_rp", *group_cols, *[F.coalesce(F.sum(f"_pt{i}").over(wp), F.lit(0)).alias(f"_off{i}")
                                                       for i in range(len(names))])
    out = s.join(per_piece, ["_rp", *group_cols], "left")
    out = out.withColumns({n: (F.col(f"_off{i}") + F.col(f"_loc{i}")) for i, n in enumerate(names)})
    return out.drop(*[f"_{x}{i}" for i in range(len(names)) for x in ("loc", "off")])


def with_running_sum(s: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value_col: str,
                     out: str) -> DataFrame:
    """One inclusive running sum (see ``with_running_sums``), as a long."""
    return with_running_sums(s, group_cols, order_cols, {out: value_col}).withColumn(out, F.col(out).cast("long"))
