"""Validation and guards (V1-V7).

Schema checks read ``df.schema`` only; data checks are single aggregations
or semi joins that stop at the first witness where possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklab.functions import names

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)

# Required columns and types per file kind (training view).
REQUIRED = {
    "interactions": (("USER_ID", "str"), ("ITEM_ID", "str"), ("OUTCOME", "float")),
    "interactions_inference": (("USER_ID", "str"), ("ITEM_ID", "str")),
    "users": (("USER_ID", "str"),),
    "items": (("ITEM_ID", "str"),),
}


class ContractViolation(ValueError):
    pass


#: V2: the Spark types that a required type accepts; a type not listed accepts all.
ACCEPTS = {"str": (T.StringType,), "float": FRACTIONAL + INTEGRAL, "double": FRACTIONAL + INTEGRAL, "int": INTEGRAL, "bool": (T.BooleanType,)}


def dtype_matches(required: str, dt: T.DataType) -> bool:
    """V2: str; float/double accept integers; int; bool; unknown passes."""
    return isinstance(dt, ACCEPTS.get(required, (T.DataType,)))


def validate_schema(df: DataFrame, file_type: str = "interactions", is_training: bool = True) -> dict:
    """V1 + V3: the difference between a table's schema and a file type's: missing columns, wrong dtypes, extra columns, rename
    suggestions, and whether it is valid."""
    view = file_type if is_training or file_type != "interactions" else "interactions_inference"
    if view not in REQUIRED:
        raise ValueError(f"unknown file_type {file_type!r}; known: {sorted(REQUIRED)}")
    wanted, has = dict(REQUIRED[view]), {f.name: f.dataType for f in df.schema.fields}
    diff = {
        "missing_columns": [c for c in wanted if c not in has],
        "wrong_dtypes": [{"column": c, "expected": t, "actual": has[c].simpleString()} for c, t in wanted.items()
                         if c in has and not dtype_matches(t, has[c])],
        "extra_columns": [c for c in has if c not in wanted],
    }
    return {"file_type": file_type, "is_training": is_training, **diff,
            "suggested_column_mapping": names.suggest_renames(diff["missing_columns"], df.columns),
            "valid": not (diff["missing_columns"] or diff["wrong_dtypes"])}


def duplicate_keys(df: DataFrame, key: str = "USER_ID") -> DataFrame:
    """Keys that occur more than once with their counts (partial aggregation)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def has_duplicate_keys(df: DataFrame, key: str = "USER_ID") -> bool:
    return len(duplicate_keys(df, key).limit(1).collect()) > 0


def validate_contract(df: DataFrame, contract: str) -> None:
    """V4: required columns, >=2 targets for wide, unique USER_ID for one-row-per-user
    contracts, list types for sequences (a schema check, no scan)."""
    from ranklab.plans.contracts import ONE_ROW_PER_USER, REQUIRED_COLUMNS
    cols = df.columns
    missing = [c for c in REQUIRED_COLUMNS.get(contract, ()) if c not in cols]
    if missing:
        raise ContractViolation(f"{contract}: missing required columns {missing}")
    if contract == "wide_multioutput":
        targets = [c for c in cols if c.startswith("ITEM_") and c != "ITEM_ID"]
        if len(targets) < 2:
            raise ContractViolation(f"wide_multioutput needs at least 2 ITEM_* targets, found {targets}")
    if contract == "prebuilt_sequences":
        if not isinstance(df.schema["ITEM_SEQUENCE"].dataType, T.ArrayType):
            raise ContractViolation("prebuilt_sequences: ITEM_SEQUENCE must be a list column")
    if contract == "sessions":
        dt = df.schema["SESSION_SEQUENCES"].dataType
        if not (isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.ArrayType)):
            raise ContractViolation("sessions: SESSION_SEQUENCES must be a list of lists")
    if contract in ONE_ROW_PER_USER and has_duplicate_keys(df, "USER_ID"):
        raise ContractViolation(f"{contract}: USER_ID must be unique; found duplicates")


def user_overlap(inter: DataFrame, users: DataFrame, user_col: str = "USER_ID") -> DataFrame:
    """V5 counts: distinct ids per side and shared ids.

    One shuffle: the two id columns are tagged (1 = interactions, 2 = users),
    unioned, OR-ed per id, and counted.
    """
    tagged = (inter.select(user_col, F.lit(1).alias("_s"))
              .unionByName(users.select(user_col, F.lit(2).alias("_s"))))
    per_id = tagged.groupBy(user_col).agg(F.bit_or("_s").alias("_f"))
    return per_id.agg(F.count_if(F.col("_f").bitwiseAND(1) == 1).alias("n_interaction_users"),
                      F.count_if(F.col("_f").bitwiseAND(2) == 2).alias("n_feature_users"),
                      F.count_if(F.col("_f") == 3).alias("n_shared"))


def check_user_overlap(inter: DataFrame, users: DataFrame, user_col: str = "USER_ID", n_samples: int = 3) -> None:
    """V5 guard: error when the two sides share no id; skipped when either side is empty.

    Finding one shared id ends the scan (``limit(1)`` on a semi join).
    """
    if inter.limit(1).count() == 0 or users.limit(1).count() == 0:
        return
    if inter.select(user_col).join(users.select(user_col), user_col, "left_semi").limit(1).count() > 0:
        return
    s1 = [r[0] for r in inter.select(user_col).distinct().orderBy(user_col).limit(n_samples).collect()]
    s2 = [r[0] for r in users.select(user_col).distinct().orderBy(user_col).limit(n_samples).collect()]
    raise ContractViolation(
        f"interactions and users share no {user_col}; samples interactions={s1} users={s2}. "
        "Check that both id columns use the same encoding.")


def binary_reward_report(df: DataFrame, reward_col: str = "REWARD", n_samples: int = 5) -> DataFrame:
    """V6: rewards must be 0/1 (nulls allowed): number of bad rows and up to 5 sorted bad values.

    The sample is the ``n_samples`` smallest distinct bad values via an
    ordered limit, never a collect_set of all bad values.
    """
    r = F.col(reward_col).cast("double")
    bad = r.isNotNull() & ~r.isin(0.0, 1.0)
    n_bad = df.agg(F.count_if(bad).alias("n_bad"))
    samples = (df.filter(bad).select(r.alias("v")).distinct().orderBy("v").limit(n_samples)
               .agg(F.sort_array(F.collect_list("v")).alias("samples")))
    return n_bad.crossJoin(F.broadcast(samples))   # one row beside one row


def check_binary_rewards(df: DataFrame, reward_col: str = "REWARD") -> None:
    row = binary_reward_report(df, reward_col).first()
    if row["n_bad"]:
        raise ContractViolation(f"{reward_col} must be binary 0/1; {row['n_bad']} rows are not, e.g. {row['samples']}")


def require_per_label_decision(contract: str, metric_kind: str, per_label: bool | None) -> None:
    """V7: multi-target data, or long data with classification metrics, needs an explicit per_label choice."""
    if per_label is None and (contract == "wide_multioutput" or metric_kind == "classification"):
        raise ValueError("pass per_label=True (one row per target) or per_label=False (macro mean only)")
