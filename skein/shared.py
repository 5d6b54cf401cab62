"""Lineage cuts and small helpers shared by the operators.

Intermediate results that are read more than once are written as Parquet below
the folder that the session names in ``spark.checkpoint.dir``; every executor
sees that folder, so a lost executor costs a re-read and nothing else.  Only on
a local master (tests, notebooks) a folder of this machine is made where the
setting is missing; on a cluster that is an error.  What was written is deleted
when the driver ends, or by :func:`release`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def _file_system(spark: SparkSession, path: str):
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), named


def release() -> None:
    """Delete everything that :func:`written` wrote so far; tables read from it can't be read any more."""
    while _WRITTEN:
        fs, path = _file_system(*_WRITTEN.pop())
        fs.delete(path, True)


@atexit.register
def _remove_own() -> None:
    for path in _OWN_DIRS.values():
        shutil.rmtree(path, ignore_errors=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's, or a local one on a local master without any."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="skein-")
    return f"file://{_OWN_DIRS[app]}"


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, named = _file_system(spark, path)
    fs.deleteOnExit(named)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def parts_for(rows: int, per_part: int = 100_000, most: int = 20_000) -> int:
    """Partitions so that none holds many more than ``per_part`` rows."""
    return max(1, min(most, -(-rows // per_part)))


#: Rows of one key that one task should join, and hot keys up to which a list of them is broadcast.
ROWS_PER_TASK, BROADCAST_KEYS = 200_000, 100_000


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", rows_per_task: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined to ``few`` (unique in ``key``), the rows of a hot key in as many parts as they need.

    Keys are counted first, from partial sums, in ``counted`` if given (a table
    with at least the rows of ``many``, cheaper to read); only those with more
    than ``rows_per_task`` rows are split, and ``few`` is repeated for these alone.
    """
    rows = rows_per_task or ROWS_PER_TASK
    source = many if counted is None else counted
    hot = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.floor(F.count(F.lit(1)) / rows).cast("int").alias("_last")).where("_last > 0")
    found = hot.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return many.join(few, key, how)
    side = F.broadcast(many.sparkSession.createDataFrame(found, hot.schema)) if len(found) <= BROADCAST_KEYS else written(hot, "hot")
    others = [c for c, t in many.dtypes if c != key and not t.startswith("map")] or [key]
    placed = many.join(side, key, "left").withColumn("_part", F.pmod(F.xxhash64(*others), F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")
    split = few.join(side, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0))))).drop("_last")
    return placed.join(split, [key, "_part"], how).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(c: Column) -> Column:
    """Id without surrounding white space and letter case; blank counts as null."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)
