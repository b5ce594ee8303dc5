"""Written intermediate tables of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table is broadcast.
FEW_ROWS = 100_000

_ROOTS: set[str] = set()
_LOCAL: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset: below the warehouse, or on a local master a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    elif not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/.millrace"
    root = f"{folder}/millrace-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    """Deletes the tables when the driver's Python ends, if its JVM is still there."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        return


def settle(df: DataFrame, *folders: str) -> DataFrame:
    """Writes df as Parquet, in folders of the columns named, and reads it back: lineage ends there, and a lost executor takes nothing with it."""
    path = f"{_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a side of a join: broadcast if it was counted to few rows, else sorted and merged.

    Spark would broadcast by bytes of files or of a shuffle, and ten million ids are packed into as few as ten megabytes.
    """
    return F.broadcast(df) if rows is not None and rows <= FEW_ROWS else df.hint("merge")
