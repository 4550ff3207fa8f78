"""Session settings and tables written to the cluster's shared folder."""

from __future__ import annotations

import os
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No call-site lookup for every column built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "paceline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; the executors' Python gets this package."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once an application: they need not have it installed.

    The archive lies among the driver's Spark files, from which Spark hands it out.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(SparkFiles.getRootDirectory(), f"{root.name}-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir`` as the cluster names it, else a folder in the warehouse,
    which all executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/paceline-scratch"


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialise(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, cutting its lineage. Runs a job."""
    path = scratch_path(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def materialise_by(frame: DataFrame, key: str, purpose: str, dealt: bool = False) -> DataFrame:
    """Write a frame to the shared folder in buckets by a key, ``spark.sql.shuffle.partitions`` of them, and read it back. Runs a job.

    Grouping by the key, and joins of such tables on it, then need no exchange. For keys without a hot value: a bucket is written by
    one task. ``dealt`` says that rows come as another such table has them, so that no exchange is needed. The table's name is known to this
    session alone.
    """
    spark = frame.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"paceline_{uuid.uuid4().hex}"
    rows = frame if dealt else frame.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, purpose)).saveAsTable(name)
    return spark.table(name)
