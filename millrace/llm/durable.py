"""Written tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one the cluster names in spark.checkpoint.dir.

    Where that is unset: below the warehouse, which all executors share, or on a local master a temporary folder.
    """
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


_ROOTS: set[str] = set()
_LOCAL: dict[str, str] = {}


def _remove(spark: SparkSession, root: str) -> None:
    """Deletes this application's tables when the driver's Python ends and its JVM is still there."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        return


def durable(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Later plans start from those files, so an executor that is lost takes nothing with it, and numbers
    given by monotonically_increasing_id() stay what they were.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as texts are long: the buffers of both sides grow with the largest batch.

    The setting is the session's, is only ever lowered, and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(c for c in (spark.conf.get(key, None) or "") if c.isdigit())
    if not now or int(now) > BATCH_BYTES or not int(now):
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
