"""Session and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in NAMES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: How many rows a task of Python work gets, whatever the table has.
ROWS_A_TASK = 50_000


def spread(rows: DataFrame, key: str | list[str], of: DataFrame | None = None) -> DataFrame:
    """``rows`` for Python work, dealt by ``key`` to tasks of about ``ROWS_A_TASK``
    rows, at least as many as the session has cores: splits of a scan and
    partitions of a join are made for native work and hold millions. ``of``: a
    table of about as many rows that is cheaper to count (files have their counts)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-(rows if of is None else of).count() // ROWS_A_TASK)), *([key] if isinstance(key, str) else key))
