"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(c) -> Column:
    """Whole epoch seconds of a timestamp column, independent of the session time zone.

    ``TIMESTAMP_NTZ`` values are read as wall-clock UTC; ``TIMESTAMP`` values are
    converted to wall clock in the session zone first, so pin the session to UTC
    when mixing both.
    """
    return F.timestamp_diff("SECOND", F.expr(_EPOCH_NTZ), col(c).cast("timestamp_ntz"))


def epoch_micros(c) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), col(c).cast("timestamp_ntz"))


def seeded_hash(seed, *keys) -> Column:
    """Deterministic uniform draw as a 32-hex-digit md5 string.

    ``md5(concat_ws('|', seed, key...))`` gives the same text in every SQL
    engine that has md5, so random splits are reproducible and checkable.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))
