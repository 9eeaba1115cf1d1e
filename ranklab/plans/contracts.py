"""The nine table contracts (required columns, detection, dataset type) and
schema generation (R7, R8, J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Contract names and their required columns.
REQUIRED_COLUMNS = {
    "long_interactions": ("USER_ID", "ITEM_ID", "OUTCOME"),
    "long_with_timestamp": ("USER_ID", "ITEM_ID", "OUTCOME", "TIMESTAMP"),
    "long_multi_reward": ("USER_ID", "ITEM_ID", "OUTCOME"),
    "wide_multioutput": ("USER_ID",),
    "multiclass": ("USER_ID", "ITEM_ID"),
    "prebuilt_sequences": ("USER_ID", "ITEM_SEQUENCE"),
    "sessions": ("USER_ID", "SESSION_SEQUENCES"),
    "users_features": ("USER_ID",),
    "items_features": ("ITEM_ID",),
}
CONTRACTS = tuple(REQUIRED_COLUMNS)
ONE_ROW_PER_USER = ("wide_multioutput", "multiclass", "prebuilt_sequences", "sessions", "users_features")

DATASET_TYPE = {
    "long_interactions": "interactions",
    "long_with_timestamp": "interactions",
    "long_multi_reward": "interactions",
    "prebuilt_sequences": "interactions",
    "sessions": "interactions",
    "wide_multioutput": "interaction_multioutput",
    "multiclass": "interaction_multiclass",
}


def contract_from_columns(columns, empty: bool = False) -> str:
    """R7 detection precedence: empty -> unknown; sequences; sessions; long
    (timestamp first, then OUTCOME_*); multiclass; wide (>=2 ITEM_*); unknown."""
    cols = set(columns)
    if empty or not cols:
        return "unknown"
    if "ITEM_SEQUENCE" in cols and "USER_ID" in cols:
        return "prebuilt_sequences"
    if "SESSION_SEQUENCES" in cols:
        return "sessions"
    if {"USER_ID", "ITEM_ID", "OUTCOME"} <= cols:
        if "TIMESTAMP" in cols:
            return "long_with_timestamp"
        if any(c.startswith("OUTCOME_") for c in cols):
            return "long_multi_reward"
        return "long_interactions"
    if {"USER_ID", "ITEM_ID"} <= cols:
        return "multiclass"
    if "USER_ID" in cols and len([c for c in cols if c.startswith("ITEM_")]) >= 2:
        return "wide_multioutput"
    return "unknown"


def contract_from_dataframe(df: DataFrame) -> str:
    """R7 on a DataFrame: schema plus one ``isEmpty`` probe."""
    return contract_from_columns(df.columns, empty=df.isEmpty())


def dataset_type(contract: str) -> str:
    """R8."""
    return DATASET_TYPE.get(contract, "interactions")


def generate_schema(df: DataFrame) -> T.StructType:
    """Inferred types with name overrides: USER_ID/ITEM_ID -> string;
    OUTCOME, OUTCOME_*, ITEM_* (not ITEM_ID) -> double."""
    fields = []
    for f in df.schema.fields:
        n = f.name
        if n in ("USER_ID", "ITEM_ID"):
            dt = T.StringType()
        elif n == "OUTCOME" or n.startswith("OUTCOME_") or (n.startswith("ITEM_") and n not in ("ITEM_SEQUENCE",)):
            dt = T.DoubleType()
        else:
            dt = f.dataType
        fields.append(T.StructField(n, dt, True))
    return T.StructType(fields)


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast a frame to a schema by name (one projection)."""
    from pyspark.sql import functions as F
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else
                       F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
