"""Storage that driver and executors share: the folder in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, but only if all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quillbase-")
        base = _OWN[app]
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _PATHS[made] = path
    return made


def drop_stored(df: DataFrame) -> None:
    """Removes the folder of a table made by stored() that no later step reads."""
    remove(df.sparkSession, _PATHS.pop(df))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
