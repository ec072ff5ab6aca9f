"""Small helpers around ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from corvane.runtime import arrow_rows

#: Rows of an Arrow batch: small enough that a batch of long texts fits a worker.
BATCH_ROWS = 1000


def schema_of(ddl: str) -> StructType:
    """The schema that a DDL string names."""
    return _parse_datatype_string(ddl)


def flat_map(df: DataFrame, rows: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """``rows(*columns)`` for each row of ``df``; what it yields are the rows of the result.

    The columns of ``df`` are given in order as Python values. Output goes out in batches of
    bounded size, whatever the number of rows that one input row makes."""
    arrow_rows(df.sparkSession, BATCH_ROWS)
    target = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = target.names
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                for row in rows(*values):
                    out.append(row)
                    if len(out) >= 4 * BATCH_ROWS:
                        yield _batch(out, names, target)
                        out = []
            if out:
                yield _batch(out, names, target)

    return df.toDF(*(f"_{k}" for k in range(len(df.columns)))).mapInArrow(run, ddl)


def _batch(rows: list[tuple], names: list[str], target: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, type=target.field(k).type) for k, values in enumerate(zip(*rows))]
    return pa.RecordBatch.from_arrays(columns, schema=target)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
