"""Work folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_ROOT: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or else that of setCheckpointDir; a temporary one only where neither is set and
    driver and executors are one process. It is deleted when the session ends."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _ROOT.setdefault("tmp", tempfile.mkdtemp(prefix="wachter-"))
    path = f"{root.rstrip('/')}/wachter/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
