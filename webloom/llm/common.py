"""What the operators share: materialised tables in the shared folder, bounded batches, word classes."""

from __future__ import annotations

import re
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.shared import fresh_dir, keep

#: ASCII capitals and their small letters; other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch: what a task holds of texts at a time, in the JVM and in Python, beside a single longer one.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def lean(df: DataFrame) -> DataFrame:
    """Lowers the session's bound of Arrow batches to ``BATCH_BYTES`` where it is higher: ten thousand texts, or 64 MB of them, are too many for small executors."""
    conf = df.sparkSession.conf
    n, unit = re.fullmatch(r"(\d+)([a-z]*)", str(conf.get(_BATCH, str(64 << 20))).lower()).groups()
    if int(n) * _UNITS.get(unit, 1) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Computes a table once, into the shared folder; its lineage ends there."""
    return keep(df)


def few(df: DataFrame, rows: int, each: int) -> DataFrame:
    """No more partitions than one for ``each`` of so many rows: small tables that go round by round needn't be hundreds of files each time."""
    return df.coalesce(1 + rows // each)


def written(df: DataFrame, what: str) -> DataFrame:
    """Computes a table once, as Parquet in the shared folder: smaller than ``materialise`` for tables of many rows."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_digest(c: Column) -> Column:
    """128 bits of a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker; functions sent by value have no module of their own."""
    name = "_webloom_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].kept = {}
    return sys.modules[name].kept
