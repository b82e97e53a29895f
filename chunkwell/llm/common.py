"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that are turned into Python objects at a time.
SLICE_ROWS = 400


def slices(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stream in small batches, so that a worker holds few of them as objects."""
    for batch in stream:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def texts_of(column: pa.Array) -> list[str]:
    """A text column as Python strings; NULL is the empty text."""
    return [t or "" for t in column.to_pylist()]


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    rest: str,
    setup: Callable[[], Callable[[list[str]], dict[str, list]]],
) -> DataFrame:
    """``(id, ...)`` with columns ``rest`` (DDL) made from the texts, one row per input row.

    ``setup`` runs once per task and returns the function from the texts of a batch to
    the columns. Batches are streamed, so no task holds its partition; ids pass through
    as they are; no other column is read.
    """
    fields = [T.StructField("id", docs.schema[id_col].dataType)]
    schema = T.StructType(fields + T.StructType.fromDDL(rest).fields)
    arrow = to_arrow_schema(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = setup()
        for batch in slices(stream):
            made = fn(texts_of(batch.column(1)))
            columns = [batch.column(0).cast(arrow.field(0).type)]
            for field in list(arrow)[1:]:
                columns.append(pa.array(made[field.name], type=field.type))
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)
