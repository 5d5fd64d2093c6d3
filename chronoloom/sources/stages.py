"""Tables written once to the shared folder and read by whatever comes after, to cut lineage and repeated scans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_HELD: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset, as in tests."""
    conf = spark.sparkContext.getConf()
    if not (root := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)):
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chronoloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a table was last written, and its bytes."""
    files, target = _files(spark, path)
    return files.getFileStatus(target).getModificationTime(), files.getContentSummary(target).getLength()


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make gives out of the table at path source, written once for each application and state of source."""
    key = (spark.sparkContext.applicationId, source, name, *stamp(spark, source))
    if key not in _HELD or not exists(spark, _HELD[key]):
        path = f"{shared_dir(spark)}/chronoloom-{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _HELD[key] = path
    return spark.read.parquet(_HELD[key])
