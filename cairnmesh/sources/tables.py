"""Cutting a plan where several later steps use it, and folders that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where none is set, on one machine, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cairnmesh-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, as lazy results may read it until then."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with suppress(Exception):  # never written, or the folder's owner has cleared it
            fs, at = pafs.FileSystem.from_uri("file:///" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path)
            fs.delete_dir(at)

    atexit.register(drop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, as columns; steps that use it several times don't plan it again."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
