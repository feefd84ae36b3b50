"""Where jobs keep what must outlive a lost executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to all tasks at most.
MOST_SENT = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only in local mode, where all run on one machine,
    a temporary folder takes its place if it is unset; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tillstream-")


def sent(rows: DataFrame) -> DataFrame | None:
    """rows, to be sent to all tasks, or None if they are too many for that."""
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else None


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder; it is no error if there is none."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def folder(spark: SparkSession, names: tuple[str, ...], values: tuple) -> str:
    """The relative path of a partition, its values escaped as the writer does."""
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(utils.getPartitionPathString(c, v if v is None else str(v)) for c, v in zip(names, values, strict=True))


def subfolders(spark: SparkSession, path: str, name: str) -> list[str]:
    """The partitions of one column below a folder, as text, largest first; a null one is last."""
    p, fs = _path(spark, path)
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    values = [utils.unescapePathName(x.removeprefix(f"{name}=")) for x in found if x.startswith(f"{name}=")]
    return sorted(values, key=lambda v: (v != "__HIVE_DEFAULT_PARTITION__", v), reverse=True)
