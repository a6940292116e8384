"""Shared-folder tables that cut lineage, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset (tests, one machine) a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cairnmesh-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


#: Shuffle files of a finished job are removed at once instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _writing = threading.Lock(), {}


@contextmanager
def _cleaned(spark: SparkSession):
    """CLEANUP holds while any table of the session is being written; the session's own setting is back afterwards."""
    conf, key = spark.conf, id(spark._jsparkSession)
    with _lock:
        many, before = _writing.get(key, (0, None))
        before = before if many else conf.get(CLEANUP, "false")
        _writing[key] = (many + 1, before)
        conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            many, before = _writing.pop(key)
            if many > 1:
                _writing[key] = (many - 1, before)
            else:
                conf.set(CLEANUP, before)


class Scratch:
    """Parquet tables in the shared folder.

    ``keep`` writes a DataFrame and reads it back, so later stages survive the
    loss of the executors that computed it. Tables go when ``drop`` is called,
    else when the driver ends, since lazy results may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        with _cleaned(self.spark):  # the table is all that is needed of this job
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame | None = None) -> None:
        """Delete one kept table, or all."""
        try:
            paths = [f.rpartition("/")[0] for f in table.inputFiles()[:1]] if table is not None else [self.root]
            jvm = self.spark.sparkContext._jvm
            for p in paths:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: the folder's owner clears it
            if table is not None:
                raise


_shipped: set[str] = set()


#: Arrow batches by bytes and rows: with texts of any length a worker holds a few MB at a time.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't have it installed, and bound the session's Arrow batches."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    folder = tempfile.mkdtemp(prefix="cairnmesh-ship-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "cairnmesh.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)


#: A table is broadcast only where it is measured to take no more memory than this; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(24).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(8).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def fits(table: DataFrame, limit: int | None = None) -> bool:
    """Whether all rows of a written table take at most `limit` bytes (BROADCAST_BYTES), 32 for each row besides its values."""
    size = sum((_bytes(F.col(f.name), f.dataType) for f in table.schema.fields), F.lit(32).cast("long"))
    return (table.agg(F.sum(size)).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit)


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast where it fits."""
    return F.broadcast(table) if fits(table) else table


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, `row`: whatever their names, they can't clash with an operator's own. `row.*` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
