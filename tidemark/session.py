"""Session helpers: shared staging folder and small session checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a session in one local process gets a scratch folder, the
    same for all its stages. On a cluster a missing setting is an error: files in a machine's
    own folder would not be seen by the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = spark.conf.get("spark.tidemark.local.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.tidemark.local.dir", path)
    return path.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for one written stage below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
