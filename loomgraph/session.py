"""Session construction and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE, skew-join splitting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str, read: DataFrame | None = None) -> DataFrame:
    """Rows of a table as it is read (or made of ``read``), dealt by their keys over four tasks for each split, before repeats go or rows are grouped.

    A number of tasks that AQE chooses goes by compressed bytes, of which tables of groups take many times more; so a task holds a quarter of a split, however large the table.
    """
    return rows.repartition(tasks_of(rows if read is None else read), *keys)


def tasks_of(read: DataFrame) -> int:
    """Four tasks for each split of a table as it is read."""
    return 4 * read.rdd.getNumPartitions()
