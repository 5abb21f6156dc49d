"""A new folder in the storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """Below spark.checkpoint.dir; a temporary folder only where that is unset in local mode, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
    return f"{root}/{label}-{uuid.uuid4().hex}"
