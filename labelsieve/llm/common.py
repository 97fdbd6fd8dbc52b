"""Shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are turned into Python values together.
PART_ROWS = 1024
#: Label rows whose crc32 of the id's text leaves 0 here are never learnt from.
FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(id_column: str) -> Column:
    """crc32 of the id's text, modulo FOLDS."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % FOLDS


def held_out(id_column: str) -> Column:
    return fold(id_column) == 0


def computed(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """``keep`` and the given columns, each evaluated once a row.

    A projection alone would be merged with those above it, and an expression used in a
    lambda or a pushed-down filter be evaluated again at each use. Generated columns are not.
    """
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows: Python values of whole batches would take much memory."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def per_document(
    docs: DataFrame,
    work: Callable[[list], list[tuple]],
    schema: str,
    *,
    text: str = "text",
    carry: dict[str, Column] | None = None,
    binary: bool = True,
) -> DataFrame:
    """Apply ``work`` to the texts of each Arrow batch; one row out for each row in.

    ``work`` gets a list of texts (UTF-8 bytes, or str if not ``binary``; null
    is empty) and returns a list of Python values for each column of
    ``schema``. ``carry`` names the columns that go along. Nothing is shuffled.
    """
    kind = "binary" if binary else "string"
    carried = carry if carry is not None else {"doc_id": F.col("doc_id")}
    source = docs.select(
        *[column.alias(name) for name, column in carried.items()],
        whole_text(text).cast(kind).alias("__text"),
    )
    made = T.StructType.fromDDL(schema)
    out = T.StructType([*source.drop("__text").schema.fields, *made.fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            at = batch.schema.get_field_index("__text")
            columns = work(batch.column(at).to_pylist())
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept]
                + [
                    values if isinstance(values, pa.Array) else pa.array(values, type=field.type)
                    for values, field in zip(columns, arrow, strict=True)
                ],
                names=[batch.schema.names[i] for i in kept] + arrow.names,
            )

    return source.mapInArrow(run, out)

