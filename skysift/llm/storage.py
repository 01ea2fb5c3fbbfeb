"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Bytes of a batch that goes to a Python worker: texts of any length, so rows alone bound nothing.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a folder of our own if everything runs in this process (master local), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="skysift-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return f"file://{_own[sc.applicationId]}"


def bounded_batches(spark: SparkSession) -> None:
    """Holds batches to Python workers, and what the JVM keeps outside its heap for them, to BATCH_BYTES; a smaller setting stays."""
    now = spark.conf.get(_BATCH).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sky_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no later plan reads."""
    jvm, path = df.sparkSession._jvm, df._sky_path
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
