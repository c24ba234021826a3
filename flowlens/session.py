"""Session settings and the shared folder used for materialised steps."""

from __future__ import annotations

import logging
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "flowlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse.

    A folder without a scheme may be another one on each machine, so with several processes it is tried out first. A
    temporary folder stands in only where driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None  # not so for local-cluster
    if base and (alone or "://" in base or base.startswith("file:")):
        return base.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if alone:
        if current:
            return current.rstrip("/")
        base = tempfile.mkdtemp(prefix="flowlens-")
        spark.sparkContext.setCheckpointDir(base)
        return base
    for folder in (base or current, spark.conf.get("spark.sql.warehouse.dir", None)):
        if folder and _reaches_all(spark, folder.rstrip("/")):
            return folder.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


_TRIED: dict[tuple[str, str], bool] = {}


def _reaches_all(spark: SparkSession, folder: str) -> bool:
    """Whether what tasks write below the folder can be read again; tried once in an application."""
    of = spark.sparkContext.applicationId, folder
    if of not in _TRIED:
        path, rows = f"{folder}/flowlens/probe-{uuid.uuid4().hex}", 4 * max(8, spark.sparkContext.defaultParallelism)
        try:
            spark.range(0, rows, 1, rows).write.parquet(path)  # a file from each task
            _TRIED[of] = spark.read.schema("id long").parquet(path).count() == rows
        except (Py4JJavaError, PySparkException) as failed:
            logging.getLogger(__name__).warning("%s can't be used by all executors: %s", folder, str(failed)[:300])
            _TRIED[of] = False
        else:
            fs, hpath = _located(spark, path)
            fs.delete(hpath, True)
    return _TRIED[of]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/flowlens/{label}-{uuid.uuid4().hex}"


@contextmanager
def shared_path(spark: SparkSession, label: str) -> Iterator[str]:
    """A fresh path below the shared folder that is deleted afterwards."""
    path = work_path(spark, label)
    try:
        yield path
    finally:
        fs, hpath = _located(spark, path)
        fs.delete(hpath, True)


def written(df: DataFrame, label: str = "step", **options: str) -> DataFrame:
    """The table written once as Parquet below the shared folder and read back.

    Cuts the lineage, survives executor loss, and later reads fetch only the columns they use. The folder goes with
    ``drop_written``, or else when the session's JVM ends.
    """
    path = work_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    fs, hpath = _located(df.sparkSession, path)
    fs.deleteOnExit(hpath)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop_written(*tables: DataFrame) -> None:
    """Delete the folders of tables returned by ``written``, once nothing reads them any more."""
    for table in tables:
        fs, hpath = _located(table.sparkSession, table.written_to)
        fs.delete(hpath, True)


def _located(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _located(spark, path)
    return fs.exists(hpath)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, hpath = _located(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []


def text_of(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, hpath = _located(spark, path)
    opened = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()
