"""Folders for indexes that a query builds for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/tamis-index-{uuid.uuid4().hex}"
