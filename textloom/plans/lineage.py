"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one in a local session; a cluster needs it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.get("folder") or _own.setdefault("folder", tempfile.mkdtemp(prefix="textloom-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed now, written to the shared folder as Parquet and read back.

    Lost executors then cost no recomputation, and plans of loops stay short. Spark deletes the files when its JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
