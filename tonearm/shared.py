"""Session helpers: table reading, the shared folder, and cutting lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once in an application: they may have neither a copy nor the driver's path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tonearm-")) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    atexit.register(shutil.rmtree, at.parent, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if own := sc.getCheckpointDir():
        return own.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _FALLBACK:
        _FALLBACK[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tonearm-")
        sc.setCheckpointDir(_FALLBACK[sc.applicationId])
    return _FALLBACK[sc.applicationId]


def temporary(spark: SparkSession) -> str:
    """A new path in the shared folder that ``release`` deletes."""
    path = f"{shared_dir(spark)}/tonearm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan is cut, and a lost executor costs nothing.

    The files live in a folder named after the application, as long as this Python process or until ``release``.
    """
    spark = df.sparkSession
    path = temporary(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Over tasks that fill the cluster twice (by columns), for work whose input bytes say little about its CPU time."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def release() -> None:
    """Deletes what ``cut`` has written; frames built on it can't be read any more."""
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; the cluster owns the folder's clean-up
            pass
    _WRITTEN.clear()


atexit.register(release)
