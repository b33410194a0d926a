"""Snapshots and JSON state files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share; a temporary one in tests, where Spark is this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="oncelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> str:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False) -> DataFrame:
    """Rows of JSON files; a path that is not there is an empty state."""
    try:
        return spark.read.schema(schema).json(path, multiLine=multiline)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
