"""Where a job may write tables between its steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in one of our own only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="plumbline-core-"))
            atexit.register(shutil.rmtree, _own[0], True)
        folder = f"file://{_own[0]}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
