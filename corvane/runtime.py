"""Durable intermediate tables: lineage is cut by a table in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_lasting: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only where none is set (tests, one machine) is a
    local folder chosen."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"corvane-{os.getuid()}")


def durable(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows does not recompute it,
    and it outlives the loss of any executor. The folder goes when the driver process ends, and one
    that isn't ``lasting`` with the ``scratch`` it was written in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written and not _lasting:
        atexit.register(drop_all)
    (_lasting if lasting else _written).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it. Spark goes by the size of files, and written tables of
    ids and counts take few bytes a row there, many times as much in the driver that builds a broadcast."""
    return df.hint("merge")


def _drop(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may already have ended
            pass


def drop_all() -> None:
    """Remove the tables of this process; what is already gone is no error."""
    _drop(_written + _lasting)
    _written.clear()
    _lasting.clear()


@contextmanager
def scratch() -> Iterator[None]:
    """Removes, at its end, the intermediate tables that were written within: for sessions that run many
    queries. A query's result must be written or collected before."""
    begin = len(_written)
    try:
        yield
    finally:
        _drop(_written[begin:])
        del _written[begin:]


#: Bytes of an Arrow batch, beyond which it ends with the row that it is at.
ARROW_BYTES = 8 << 20


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bound the rows of an Arrow batch and its bytes, so that a batch of long rows fits a Python worker
    and the memory beside an executor's heap."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
