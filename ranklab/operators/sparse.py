"""Very wide contracts without a column an item (R1, R2, R3, R9, R15, M4-M6 for thousands of targets).

``pivot_to_wide`` makes a column of every item, so its item ids pass through the driver. Here the wide table is kept as two tables:
``cells`` (USER_ID, ITEM_ID, value), one row an observed pair, and ``users``, one row a user with its first-seen features. A pair without a
cell counts as ``fill``. Triage, melt, user rows and per-target heads read the two tables with grouped sums only; no item id reaches the driver.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklab.operators.learners import index_ids
from ranklab.operators.scoring import catalogue_top_k
from ranklab.session import materialize


@dataclasses.dataclass
class SparseWide:
    """A wide table by its observed cells; ``fill`` is the value of all other pairs of a user and a target."""
    cells: DataFrame
    users: DataFrame
    fill: float = 0.0


def pivot_sparse(df: DataFrame, user_col: str = "USER_ID", item_col: str = "ITEM_ID", outcome_col: str = "OUTCOME",
                 order_cols: Sequence[str] | None = None, fill: float = 0.0) -> SparseWide:
    """R1 + R2 for any number of items: cells hold max(outcome) of a pair, named ``ITEM_<item>``; users their first-seen other columns.

    Rows with a null user or item are dropped; pairs whose outcomes are all null have no cell and count as ``fill``, as in ``pivot_to_wide``.
    Both tables are written once: every reader takes its columns from them instead of the rows behind.
    """
    base = df.filter(F.col(user_col).isNotNull() & F.col(item_col).isNotNull())
    pair = [F.col(user_col).alias("USER_ID"), F.concat(F.lit("ITEM_"), F.col(item_col).cast("string")).alias("ITEM_ID")]
    cells = base.groupBy(*pair).agg(F.max(F.col(outcome_col).cast("double")).alias("value")).filter("value is not null")
    feats = [c for c in df.columns if c not in (user_col, item_col, outcome_col)]
    users = base.select(pair[0], *[F.col(c) for c in feats if c != "USER_ID"])
    if feats:
        users = users.groupBy("USER_ID").agg(F.min_by(F.struct(*feats), F.struct(*(order_cols or feats))).alias("_f")).select("USER_ID", "_f.*")
    else:
        users = users.distinct()
    return SparseWide(materialize(cells, "cells"), materialize(users, "cell-users"), fill)


def user_rows(s: SparseWide, out: str = "TARGETS") -> DataFrame:
    """One row a user: its features and a map from target to value, observed targets only, in order of their names.

    A row is as long as the user's distinct items, which is what a wide row is; repeated pairs were merged before.
    """
    entry = F.struct(F.col("ITEM_ID").alias("key"), F.col("value"))
    maps = s.cells.groupBy("USER_ID").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return s.users.join(maps, "USER_ID", "left").withColumn(out, F.coalesce(out, empty))


def melt_cells(s: SparseWide) -> DataFrame:
    """The observed pairs as long rows (USER_ID, features.., ITEM_ID, OUTCOME), features riding along."""
    return s.users.join(s.cells, "USER_ID").select("USER_ID", *[c for c in s.users.columns if c != "USER_ID"], "ITEM_ID", F.col("value").alias("OUTCOME"))


def _totals(s: SparseWide) -> DataFrame:
    return s.cells.groupBy("ITEM_ID").agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("value").alias("_distinct"), F.min("value").alias("_lo"),
                                          F.max((F.col("value") == s.fill).cast("int")).alias("_has_fill"),
                                          F.count_if(~F.col("value").isin(0.0, 1.0)).alias("n_nonbinary"))


def cell_manifest(s: SparseWide, n_samples: int = 5) -> DataFrame:
    """R9 over cells: (column, status, value_seen, samples, n_nonnull, n_distinct), as ``target_manifest`` gives for the wide table.

    A target that some user has no cell of also holds ``fill``.
    """
    n = s.users.count()
    t = _totals(s)
    filled = F.col("n_cells") < n
    fill_bad = F.lit(0 if s.fill in (0.0, 1.0) else 1)
    t = t.select(F.col("ITEM_ID").alias("column"), F.lit(n).cast("long").alias("n_nonnull"),
                 (F.col("_distinct") + F.when(filled & (F.col("_has_fill") == 0), 1).otherwise(0)).cast("long").alias("n_distinct"),
                 (F.col("n_nonbinary") + F.when(filled, fill_bad).otherwise(0)).alias("_bad"), filled.alias("_filled"), "_lo")
    status = F.when(F.col("_bad") > 0, "bad_non_binary").when(F.col("n_distinct") < 2, "degenerate").otherwise("ok")
    t = t.withColumn("status", status)
    bad = s.cells.filter(~F.col("value").isin(0.0, 1.0)).select(F.col("ITEM_ID").alias("column"), "value")
    if s.fill not in (0.0, 1.0):
        bad = bad.unionByName(t.filter("_filled").select("column", F.lit(float(s.fill)).alias("value")))
    w = Window.partitionBy("column").orderBy("value")
    smp = (bad.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= n_samples).groupBy("column")
           .agg(F.transform(F.array_sort(F.collect_set("value")), lambda x: x.cast("string")).alias("samples")))
    return t.join(smp, "column", "left").select("column", "status", F.when(F.col("status") == "degenerate", F.col("_lo")).alias("value_seen"),
                                                F.when(F.col("status") == "bad_non_binary", F.col("samples")).alias("samples"), "n_nonnull", "n_distinct")


def drop_targets(s: SparseWide, names: DataFrame) -> SparseWide:
    """Without the targets in ``names`` (column), by an anti join."""
    return dataclasses.replace(s, cells=s.cells.join(names.select(F.col("column").alias("ITEM_ID")), "ITEM_ID", "left_anti"))


# ----------------------------------------------------------------- heads


def _design(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """USER_ID and _x0.. = 1 and the features; nulls and NaN count as 0."""
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in numeric]
    return df.select("USER_ID", F.lit(1.0).alias("_x0"), *[c.alias(f"_x{j + 1}") for j, c in enumerate(x)])


def linear_heads(s: SparseWide, numeric: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """M5, M6 for thousands of targets: least squares of every target on the users' features, over *all* users, in two grouped sums.

    X'X is the same for every target: one small matrix (features + 1 squared). X'y of a target needs only its cells, as ``fill`` moves the
    intercept alone. Returns (ITEM_ID, beta): intercept, then a coefficient a feature. ``ridge`` is added to the diagonal, the intercept's apart;
    features that do not vary, or depend on others, share what they explain (least-norm solution).
    """
    d = len(numeric) + 1
    x = _design(s.users, numeric)
    xx = x.agg(*[F.sum(F.col(f"_x{a}") * F.col(f"_x{b}")).alias(f"s{a}_{b}") for a in range(d) for b in range(a, d)]).first()
    gram = np.array([[float(xx[f"s{min(a, b)}_{max(a, b)}"] or 0.0) for b in range(d)] for a in range(d)])
    gram += ridge * np.diag([0.0] + [1.0] * (d - 1))
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))          # columns of equal length, so that the inverse is well scaled
    inverse = np.linalg.pinv(gram * scale[:, None] * scale[None, :], hermitian=True) * scale[:, None] * scale[None, :]
    y = F.col("value") - s.fill
    sums = s.cells.join(x, "USER_ID").groupBy("ITEM_ID").agg(*[F.sum(y * F.col(f"_x{a}")).alias(f"g{a}") for a in range(d)])
    beta = [sum((F.lit(float(inverse[a][b])) * F.col(f"g{b}") for b in range(d)), F.lit(float(s.fill) if a == 0 else 0.0)) for a in range(d)]
    return sums.select("ITEM_ID", F.array(*beta).alias("beta"))


def score_heads(heads: DataFrame, pairs: DataFrame, numeric: Sequence[str], out: str = "score") -> DataFrame:
    """The head's value for every row of ``pairs`` (USER_ID, ITEM_ID, features); null for targets without a head."""
    z = F.col("_beta")[0]
    for j, c in enumerate(numeric):
        z = z + F.col("_beta")[j + 1] * F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    return pairs.join(heads.select("ITEM_ID", F.col("beta").alias("_beta")), "ITEM_ID", "left").withColumn(out, z).drop("_beta")


def fit_discriminant(df: DataFrame, numeric: Sequence[str], label_col: str = "ITEM_ID", ridge: float = 1e-3) -> DataFrame:
    """M4 for any number of classes: linear discriminants, (class, beta) with the intercept first.

    The class posterior of Gaussian classes with one shared covariance is a softmax of linear scores, so one grouped sum by class (counts and
    feature sums) and one of the features' products give the maximum-likelihood model; the driver holds features squared, whatever the
    number of classes. ``ridge`` is a share of the mean variance, added to each. Rows without a class take no part; null and NaN features count as 0.
    """
    d = len(numeric)
    base = df.filter(F.col(label_col).isNotNull())
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(f"_x{j}") for j, c in enumerate(numeric)]
    x = base.select(F.col(label_col).alias("_c"), *x)
    top = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_x{a}").alias(f"m{a}") for a in range(d)]).first()
    n, mean = int(top["n"]), [float(top[f"m{a}"] or 0.0) for a in range(d)]
    x = x.select("_c", *[(F.col(f"_x{a}") - mean[a]).alias(f"_x{a}") for a in range(d)])       # centred, so that products do not cancel
    pair = [(a, b) for a in range(d) for b in range(a, d)]
    classes = materialize(x.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_x{a}").alias(f"m{a}") for a in range(d)],
                                              *[F.sum(F.col(f"_x{a}") * F.col(f"_x{b}")).alias(f"p{a}_{b}") for a, b in pair]), "classes")
    s = classes.agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.col(f"p{a}_{b}") - F.col("n") * F.col(f"m{a}") * F.col(f"m{b}")).alias(f"s{a}_{b}") for a, b in pair]).first()
    cov = np.array([[float(s[f"s{min(a, b)}_{max(a, b)}"] or 0.0) for b in range(d)] for a in range(d)]).reshape(d, d) / max(1, n - int(s["k"]))
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    sd[sd == 0] = 1.0
    inverse = np.linalg.inv(cov / sd[:, None] / sd[None, :] + ridge * np.eye(d)) / sd[:, None] / sd[None, :] if d else cov
    slope = [sum((F.lit(float(inverse[a][b])) * F.col(f"m{b}") for b in range(d)), F.lit(0.0)) for a in range(d)]
    half = sum((slope[a] * F.col(f"m{a}") for a in range(d)), F.lit(0.0)) / 2
    shift = sum((slope[a] * mean[a] for a in range(d)), F.lit(0.0))
    return classes.select(F.col("_c").alias(label_col), F.array(F.log(F.col("n") / float(max(1, n))) - half - shift, *slope).alias("beta"))


def discriminant_top_k(model: DataFrame, df: DataFrame, numeric: Sequence[str], k: int, id_col: str = "USER_ID", label_col: str = "ITEM_ID") -> DataFrame:
    """(id, class, score, rank): the k classes of highest linear score for every id, by the blocked products of ``catalogue_top_k``.

    Ids and classes of any type travel as dense numbers; classes of equal score go by their order. Rows of one id are one query, its smallest features.
    """
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in numeric]
    ids, classes = (materialize(index_ids(t.select(F.col(c).alias("_id")), "_id", "_n"), "dense-ids") for t, c in ((df, id_col), (model, label_col)))
    q = df.select(F.col(id_col).alias("_id"), F.array(F.lit(1.0), *x).alias("embedding")).groupBy("_id").agg(F.min("embedding").alias("embedding"))
    q = q.join(ids, "_id").select(F.col("_n").alias("_q"), "embedding")
    c = model.select(F.col(label_col).alias("_id"), F.col("beta").alias("embedding")).join(classes, "_id").select(F.col("_n").alias("_c"), "embedding")
    top = catalogue_top_k(q, c, k, "_q", "_c")
    top = top.join(ids.select(F.col("_n").alias("_q"), F.col("_id").alias(id_col)), "_q").join(classes.select(F.col("_n").alias("_c"), F.col("_id").alias(label_col)), "_c")
    return top.select(id_col, label_col, "score", "rank")
