"""Access to tables and to the session's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (a file or a directory of parts)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that setting is absent and the master is this very machine, as
    in tests, a temporary folder is made; on a cluster without the setting this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="brindle-")


def run_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below ``shared_dir`` for each call, so that no two runs write to the same files."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
