"""Profiling (P1-P12): one or two aggregations per table, results as DataFrames.

Nothing here collects data to the driver except one-row summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklab.functions import names

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
LARGE_TABLE_ROWS = 100_000


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def column_summary(df: DataFrame, n_samples: int = 5, approx: bool = False) -> DataFrame:
    """Per column name, dtype, null_count, n_unique (nulls dropped) and sample values.

    Counts come from ONE aggregation. Samples are the ``n_samples`` smallest
    distinct non-null values in text form (file order does not exist in
    Spark): an unpivot to (column, value), a distinct, and a
    ``row_number() <= n`` that Spark prunes per task before the shuffle.
    """
    aggs = []
    for c in df.columns:
        cc = F.col(f"`{c}`")
        nd = F.approx_count_distinct(cc) if approx else F.countDistinct(cc)
        aggs += [F.count_if(cc.isNull()).alias(f"n__{c}"), nd.alias(f"u__{c}")]
    one = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(dtypes[c]).alias("dtype"),
                              F.col(f"`n__{c}`").cast("long").alias("null_count"),
                              F.col(f"`u__{c}`").cast("long").alias("n_unique")) for c in df.columns])
    counts = one.select(F.explode(rows).alias("r")).select("r.*")
    if n_samples <= 0:
        return counts
    vals = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v"))
                                         for c in df.columns])).alias("r")).select("r.*")
    w = Window.partitionBy("name").orderBy("v")
    # the rank limit prunes in each task, so only a few rows a column are made distinct
    samples = (vals.filter(F.col("v").isNotNull()).withColumn("_rn", F.dense_rank().over(w)).filter(F.col("_rn") <= n_samples).distinct()
               .groupBy("name").agg(F.sort_array(F.collect_list("v")).alias("sample_values")))
    return counts.join(samples, "name", "left")


def target_type_expr(c: Column, numeric: bool) -> list[Column]:
    """Aggregates for P6 over one column; combine with ``classify_from``."""
    nn = c.isNotNull()
    return [
        F.countDistinct(c).alias("_nd"),
        F.coalesce(F.bool_and(F.when(nn, c.cast("double").isin(0.0, 1.0))), F.lit(True)).alias("_bin") if numeric
        else F.coalesce(F.bool_and(F.when(nn, c.cast("string").isin("0", "1", "0.0", "1.0", "true", "false"))),
                        F.lit(True)).alias("_bin"),
        (F.coalesce(F.bool_and(F.when(nn, c.cast("double").isin(*[float(i) for i in range(1, 11)]))), F.lit(True))
         if numeric else F.lit(False)).alias("_rating"),
    ]


def classify_from(nd: Column, is_bin: Column, is_rating: Column, numeric: bool) -> Column:
    """P6 decision in order: <=1 distinct -> constant; subset of {0,1} -> binary;
    numeric with <=10 distinct all in 1..10 -> rating; numeric -> continuous; else categorical."""
    return (F.when(nd <= 1, "constant").when(is_bin, "binary")
            .when(F.lit(numeric) & (nd <= 10) & is_rating, "rating")
            .when(F.lit(numeric), "continuous").otherwise("categorical"))


def classify_target(df: DataFrame, column: str) -> DataFrame:
    """P6 as a one-row DataFrame (column, n_unique, target_type)."""
    numeric = isinstance(df.schema[column].dataType, NUMERIC + (T.BooleanType,))
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.BooleanType):
        c = c.cast("int")
    a = df.agg(*target_type_expr(c, numeric))
    return a.select(F.lit(column).alias("column"), F.col("_nd").cast("long").alias("n_unique"),
                    classify_from(F.col("_nd"), F.col("_bin"), F.col("_rating"), numeric).alias("target_type"))


def profile_interactions(df: DataFrame, user_col: str | None = None, item_col: str | None = None,
                         target_col: str | None = None, ts_col: str | None = None) -> DataFrame:
    """P1, P6-P9 in one aggregation: rows, users, items, sparsity, duplicate pairs,
    target type and time range. Column roles default to name detection (P3-P5)."""
    cols = df.columns
    ids = names.detect_id_columns(cols)
    user_col = user_col or ids["user_id"]
    item_col = item_col or ids["item_id"]
    target_col = target_col or names.detect_target_column(cols)
    ts_col = ts_col or names.detect_timestamp_column(cols)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if user_col and item_col:
        aggs += [F.countDistinct(user_col).alias("n_users"), F.countDistinct(item_col).alias("n_items"),
                 # pandas `duplicated` treats null keys as equal -> distinct over a struct
                 F.countDistinct(F.struct(user_col, item_col)).alias("_pairs")]
    if target_col:
        numeric = isinstance(df.schema[target_col].dataType, NUMERIC + (T.BooleanType,))
        aggs += target_type_expr(F.col(target_col), numeric)
    if ts_col:
        t = F.col(ts_col)
        dt = df.schema[ts_col].dataType
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            parsed = t.cast("timestamp_ntz")
        elif isinstance(dt, NUMERIC):
            # epoch seconds -> wall-clock UTC, independent of the session time zone
            parsed = F.timestamp_add("SECOND", t.cast("long"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
        else:
            parsed = F.try_to_timestamp(t.cast("string")).cast("timestamp_ntz")
        aggs += [F.min(parsed).alias("min_ts"), F.max(parsed).alias("max_ts")]
    a = df.agg(*aggs)
    out = [F.col("n_rows").cast("long"), F.lit(len(cols)).cast("long").alias("n_cols")]
    if user_col and item_col:
        denom = F.col("n_users") * F.col("n_items")
        out += [F.col("n_users").cast("long"), F.col("n_items").cast("long"),
                F.when(denom > 0, 1.0 - F.col("n_rows") / denom).alias("sparsity"),
                (F.col("n_rows") - F.col("_pairs")).cast("long").alias("duplicate_pairs")]
    if target_col:
        numeric = isinstance(df.schema[target_col].dataType, NUMERIC + (T.BooleanType,))
        out.append(classify_from(F.col("_nd"), F.col("_bin"), F.col("_rating"), numeric).alias("target_type"))
    if ts_col:
        out += ["min_ts", "max_ts"]
    return a.select(*out)


def bundle_profile(inter: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None,
                   user_col: str = "USER_ID", item_col: str = "ITEM_ID") -> DataFrame:
    """Profile used for method selection.

    n_rows, n_users, sparsity, target_type (OUTCOME, or pooled over ``ITEM_*``
    targets where the pooled classes are binary/continuous/constant),
    has_timestamps, has_user_features, has_item_features.
    """
    cols = inter.columns
    targets = [c for c in cols if c.startswith("ITEM_") and c != item_col]
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.countDistinct(user_col).alias("n_users")]
    has_item = item_col in cols
    if has_item:
        aggs.append(F.countDistinct(item_col).alias("n_items"))
    if "OUTCOME" in cols:
        v = F.col("OUTCOME").cast("double")
        aggs += [F.countDistinct(v).alias("_nd"), F.coalesce(F.bool_and(F.when(v.isNotNull(), v.isin(0.0, 1.0))),
                                                             F.lit(True)).alias("_bin")]
        a = inter.agg(*aggs)
    elif targets:
        # Pool the targets with one explode; every input row yields exactly
        # len(targets) rows, so the row count is recovered by division.
        long = inter.select(user_col, F.explode(F.array(*[F.col(t).cast("double") for t in targets])).alias("_v"))
        a = long.agg((F.count(F.lit(1)) / len(targets)).cast("long").alias("n_rows"),
                     F.countDistinct(user_col).alias("n_users"), F.countDistinct("_v").alias("_nd"),
                     F.coalesce(F.bool_and(F.when(F.col("_v").isNotNull(), F.col("_v").isin(0.0, 1.0))),
                                F.lit(True)).alias("_bin"))
    else:
        a = inter.agg(*aggs).withColumn("_nd", F.lit(None)).withColumn("_bin", F.lit(None))
    tt = (F.when(F.col("_nd").isNull(), F.lit(None)).when(F.col("_nd") <= 1, "constant")
          .when(F.col("_bin"), "binary").otherwise("continuous"))
    denom = F.col("n_users") * F.col("n_items") if has_item else F.lit(None)
    return a.select(
        F.col("n_rows").cast("long"), F.col("n_users").cast("long"),
        (F.when(denom > 0, 1.0 - F.col("n_rows") / denom) if has_item else F.lit(None).cast("double")).alias("sparsity"),
        tt.alias("target_type"),
        F.lit("TIMESTAMP" in cols).alias("has_timestamps"),
        F.lit(users is not None and len(users.columns) > 1).alias("has_user_features"),
        F.lit(items is not None and len(items.columns) > 1).alias("has_item_features"),
    )


def large_flags(tables: dict, threshold: int = LARGE_TABLE_ROWS) -> DataFrame:
    """(table_name, n_rows, is_large) of several tables, one count each (Parquet footers answer it)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("is_large", F.col("n_rows") > threshold)


def require_decision_for_large(n_rows: int, decided: bool | None, threshold: int = LARGE_TABLE_ROWS) -> None:
    """P12 guard on a profile's row count: larger tables need an explicit decision."""
    if decided is None and n_rows > threshold:
        raise ValueError(f"table has {n_rows:,} rows, over {threshold:,}: an explicit decision is needed (e.g. large_ok=True)")
