"""Reading items from tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_items(spark: SparkSession, path: str, columns: list[str], schema=None) -> DataFrame:
    """Only the named columns are read; with a schema nothing is inferred."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).select(*columns)


def get_item(items: DataFrame, item_id, key: str = "item_id") -> DataFrame:
    return items.filter(F.col(key) == F.lit(item_id))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
