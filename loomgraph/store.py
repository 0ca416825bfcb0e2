"""Tables that a job writes between its steps, in the folder that all executors share.

A written table cuts lineage and survives lost executors. The folder is the session's
``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one in local tests only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_scopes = threading.local()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block go at its end, but those staged with ``keep``, which belong to what encloses it.

    An operator's result reads its staged tables when it is used: use it, or stage it with ``keep``, inside the block.
    """
    folder = f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    before = getattr(_scopes, "folders", [])
    _scopes.folders = [*before, folder]
    try:
        yield
    finally:
        _scopes.folders = before
        removed(spark, folder)


def staged(df: DataFrame, label: str, by: str | None = None, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; ``by`` is a column whose values get folders of their own, for a table that is read by it. keep: for use after the scope's end."""
    spark = df.sparkSession
    folders = getattr(_scopes, "folders", [])
    folders = folders[:-1] if keep else folders
    path = f"{folders[-1] if folders else shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``staged`` wrote, once everything that reads it is written itself."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a place that only Spark may be able to reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    files, place = _folder(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []


def removed(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written under another name first."""
    files, place = _folder(spark, path)
    _, draft = _folder(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.mkdirs(place.getParent())
    files.rename(draft, place)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    files, place = _folder(spark, path)
    held = files.open(place)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    held.close()
    return text
