"""Sources and sinks.

Reads are lazy and typed once at ingest; writes refuse to overwrite or to
write onto the path being read.
"""

from __future__ import annotations

import os
from urllib.parse import urlsplit
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceNotFound(FileNotFoundError):
    pass


class InPlaceWrite(ValueError):
    pass


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """S1 + S6: Parquet by suffix or ``fmt``, else CSV with a header row.

    Pass ``schema`` for CSV in production; without it the types are inferred
    (one extra pass over the file).
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    try:
        if fmt == "parquet":
            return spark.read.parquet(path)
        if fmt == "json":
            r = spark.read
            return (r.schema(schema) if schema is not None else r).json(path)
        r = spark.read.option("header", "true")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
        return r.csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise SourceNotFound(f"file not found: {path}") from e
        raise


def recast_ids(df: DataFrame, id_cols: Sequence[str] = ("USER_ID", "ITEM_ID")) -> DataFrame:
    """Ids are categorical strings everywhere; cast once at ingest."""
    return df.withColumns({c: F.col(c).cast("string") for c in id_cols if c in df.columns})


def read_interactions(spark: SparkSession, path: str, column_mapping: dict | None = None,
                      fmt: str | None = None) -> DataFrame:
    """Read, rename by mapping (lazy, no copy), re-cast ids."""
    df = read_table(spark, path, fmt)
    if column_mapping:
        df = df.withColumnsRenamed({k: v for k, v in column_mapping.items() if k in df.columns})
    return recast_ids(df)


def from_sql(spark: SparkSession, query: str) -> DataFrame:
    """A warehouse query as a source; any DataFrame can enter a bundle."""
    return spark.sql(query)


def qualified(spark: SparkSession, path: str) -> str:
    """The full URI of a path under the session's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = urlsplit(fs.makeQualified(p).toString())
    return f"{uri.scheme}://{uri.netloc}{os.path.normpath(uri.path)}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", source_paths: Sequence[str] = (),
                partition_by: Sequence[str] = (), mode: str = "errorifexists") -> str:
    """S4 + S5 (+ S7 with ``partition_by=['split']``): write, refusing in-place writes: a target that is a source, or lies
    inside one, or holds one, with paths compared as the file system qualifies them (scheme, authority, ``..``)."""
    target = qualified(df.sparkSession, path)
    for p in source_paths:
        source = qualified(df.sparkSession, p)
        if (target + "/").startswith(source + "/") or (source + "/").startswith(target + "/"):
            raise InPlaceWrite(f"refusing to write {path} over its input {p}: choose another folder")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_splits(split_df: DataFrame, path: str, source_paths: Sequence[str] = ()) -> str:
    """One table partitioned by ``split`` instead of three files."""
    return write_table(split_df, path, "parquet", source_paths, partition_by=["split"])
