"""Stored stages: a table that several results read is computed once.

The files go to the shared folder the cluster names in ``spark.checkpoint.dir``. A lost
executor then costs the re-read of a file, not a recomputation from the raw data. Writing is a
job: a query that stores a stage runs that part while it is built.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder; where it names none, a folder below the warehouse, which is shared too."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages").rstrip("/")


def register(path: str) -> str:
    """Have ``remove_stored`` delete this path too."""
    _written.append(path)
    return path


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as Parquet and return a reader of it; ``partition_by`` columns become folders."""
    spark = df.sparkSession
    path = register(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> None:
    """Delete every stage this process has stored; queries that read them must have ended."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        place.getFileSystem(conf).delete(place, True)
