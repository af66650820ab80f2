"""A folder that driver and executors share, for steps that go through files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session may use a temporary folder instead."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "vidlake-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
