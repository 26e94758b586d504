"""Where what is written and read again within a query is kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, a local one, if all tasks run in this process."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyloom-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
