"""A place for files that all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that the session names in ``spark.checkpoint.dir``.

    Where it names none: a temporary folder if driver and executors are one process, the warehouse else.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        one = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        base = f"file://{tempfile.gettempdir()}/lociflow" if one else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lociflow-scratch"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
