"""Helpers shared by the corpus operators: scratch tables, names, vocabulary files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch as shared

#: One word, as the contracts define it for white-space separated text.
WORD = r"[^\x20\x09-\x0D]+"


#: Paths made by each application and not deleted yet.
_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path that all executors share (:func:`lociflow.scratch.path`)."""
    path = shared.path(spark, tag)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a shared table and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Jobs run inside hand Python batches of about ``n_bytes`` at most, as a row count alone doesn't bound them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n_bytes)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    known = _made.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored`, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        folder = files[0].rpartition("/")[0]
        name = folder.rpartition("/")[2]
        known = next((p for p in _made.get(df.sparkSession.sparkContext.applicationId, []) if p.rpartition("/")[2] == name), folder)
        _delete(df.sparkSession, known)


def marker(spark: SparkSession) -> int:
    """For :func:`drop_since`: what has been stored so far."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, mark: int, *but: DataFrame) -> None:
    """Delete the tables stored since ``mark``, other than ``but``. What still reads them must be done."""
    kept = {f.rpartition("/")[0].rpartition("/")[2] for df in but for f in df.inputFiles()[:1]}
    for path in _made.get(spark.sparkContext.applicationId, [])[mark:]:
        if path.rpartition("/")[2] not in kept:
            _delete(spark, path)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables that the operators left for results not yet computed. Call it once those are written."""
    drop_since(spark, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet (case-insensitively), derived from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of input that one task of an ordered pass aims at; tasks of such a pass at most.
TASK_BYTES, MAX_TASKS = 64 << 20, 100_000


def tasks_for(df: DataFrame) -> int:
    """Tasks for an ordered pass over ``df``: as Spark is set, more if its files are large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # Spark's own word for "unknown" is larger
    return max(least, min(MAX_TASKS, -(-known // TASK_BYTES)))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
