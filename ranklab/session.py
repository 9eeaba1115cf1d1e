"""Spark session and lineage helpers.

Every operator takes the session it is handed. Helpers here only fill in
settings a cluster would already carry (checkpoint folder) when they are
absent, which is the case in local tests.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is provably small; the operators add explicit
    # size checks before any broadcast hint of their own.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "ranklab",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when nothing is configured and the master is local (tests) a fresh folder
    under the system temp dir is created, and deleted when the process ends; on a cluster an unset folder is an
    error, as machines do not share their temp folders.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="ranklab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str, partition_by: tuple = ()) -> DataFrame:
    """Write ``df`` once as Parquet under the reliable checkpoint folder and read it back.

    Used before multi-pass work (model fits, several consumers of one split):
    later passes read the written table - with partition pruning when
    ``partition_by`` is given - instead of recomputing the lineage, and a lost
    executor costs a re-read, not a recomputation.
    """
    import uuid
    root = ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    drop_later(path)
    return df.sparkSession.read.parquet(path)


def materialize_buckets(df: DataFrame, name: str, by: list[str]) -> tuple[DataFrame, Callable[[], None]]:
    """Like ``materialize``, dealt by the columns ``by`` into as many buckets as the session has shuffle partitions, and what deletes it again.

    Joins and sums by these columns read the buckets as they are, without another shuffle.
    """
    import uuid
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = os.path.join(ensure_checkpoint_dir(spark), table)
    df.repartition(n, *by).write.bucketBy(n, *by).option("path", path).saveAsTable(table, format="parquet")
    drop_later(path)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, path)
    return spark.table(table), drop


_WRITTEN: list[str] = []


def drop_later(path: str) -> str:
    """Have ``path`` deleted by ``drop_materialized``, which also runs when the process ends with its session still open."""
    if not _WRITTEN:
        atexit.unregister(_drop_at_exit)
        atexit.register(_drop_at_exit)
    _WRITTEN.append(path)
    return path


def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_materialized(spark)


def drop_materialized(spark: SparkSession) -> int:
    """Delete the working tables that this process wrote, through Hadoop's FileSystem; returns their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())
    return n


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem (works for any scheme the cluster mounts)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
