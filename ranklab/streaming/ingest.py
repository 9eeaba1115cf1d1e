"""Incremental ingest with Structured Streaming (the streaming form of S1-S4).

New interaction files landing in a folder are read as a stream, given the
canonical names and types (rename, id re-cast, OUTCOME to double, timestamp
to epoch seconds) and appended to a Parquet table. The checkpoint folder
makes the append exactly-once and lets a restarted job resume where it
stopped. The reference has no streaming of its own; this is only the
ingest path kept incremental.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ranklab.functions.columns import epoch_seconds
from ranklab.session import ensure_checkpoint_dir


def canonicalize(df: DataFrame, column_mapping: dict | None = None) -> DataFrame:
    """Stateless per-row typing shared by batch and streaming ingest."""
    if column_mapping:
        df = df.withColumnsRenamed({k: v for k, v in column_mapping.items() if k in df.columns})
    casts = {c: F.col(c).cast("string") for c in ("USER_ID", "ITEM_ID") if c in df.columns}
    if "OUTCOME" in df.columns:
        casts["OUTCOME"] = F.col("OUTCOME").cast("double")
    for c in df.columns:
        if c.startswith("OUTCOME_"):
            casts[c] = F.col(c).cast("double")
    if "TIMESTAMP" in df.columns:
        dt = df.schema["TIMESTAMP"].dataType
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            casts["TIMESTAMP"] = epoch_seconds("TIMESTAMP")
        elif isinstance(dt, T.StringType):
            casts["TIMESTAMP"] = epoch_seconds(F.try_to_timestamp(F.col("TIMESTAMP")))
    return df.withColumns(casts)


def start_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                 column_mapping: dict | None = None, fmt: str = "parquet", checkpoint_dir: str | None = None,
                 available_now: bool = True, partition_by: tuple = ()) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops
    (a scheduled incremental batch), otherwise it runs continuously."""
    if checkpoint_dir is None:
        checkpoint_dir = os.path.join(ensure_checkpoint_dir(spark), "ingest-" + os.path.basename(sink_dir.rstrip("/")))
    stream = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        stream = stream.option("header", "true")
    out = canonicalize(stream.load(source_dir), column_mapping)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
