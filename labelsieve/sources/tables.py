"""CSV and Parquet tables, and report files."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelsieve.constants import BINARY_LABEL
from labelsieve.functions.columns import col, null_if_missing, numeric
from labelsieve.sources.records import BYTE_ORDER_MARK, read_records

#: Rows of a report that is written as one file.
REPORT_ROWS = 100_000


def csv_reader(spark: SparkSession, multiline: bool):
    """A reader that checks the header of every file against the schema as it scans."""
    return spark.read.options(
        header=True, escape='"', quote='"', encoding="UTF-8", multiLine=multiline, enforceSchema=False
    )


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder; the body is not read."""
    return csv_reader(spark, False).csv(path).columns


def without_mark(header) -> list[str]:
    """Column names without the byte order mark a file may begin with."""
    return [header[0].lstrip(BYTE_ORDER_MARK), *header[1:]]


def read_strings(
    spark: SparkSession, paths, *, columns=None, limit: int = None, multiline: bool = False,
    missing: bool = True, skip_ragged: bool = False, trim_header: bool = False, label: str = BINARY_LABEL,
    by_ranges: bool = False,
) -> DataFrame:
    """CSV with every column as text, so "0" and "0.0" stay apart.

    ``missing`` turns the usual spellings of a missing value into null.
    ``multiline`` admits line breaks inside quotes; such a file is read by one
    task. ``by_ranges`` admits them too and reads a file by many tasks, but
    wants balanced quotes, see ``records.read_records``. ``skip_ragged`` leaves out
    records with the wrong number of fields. ``trim_header`` takes white space
    off the column names. A ``label`` column that is read must be numeric
    throughout.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = read_header(spark, paths[0])
    if by_ranges:
        df = read_records(spark, paths, without_mark(header), ragged="ragged_" if skip_ragged else "")
        df = df.where("ragged_ IS NULL").drop("ragged_") if skip_ragged else df
    else:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        mode = "DROPMALFORMED" if skip_ragged else "PERMISSIVE"
        reader = csv_reader(spark, multiline).option("mode", mode).option("columnPruning", not skip_ragged)
        df = reader.schema(schema).csv(paths)
    df = df.toDF(*[name.strip() if trim_header else name for name in without_mark(header)])
    absent = sorted(set(columns or ()) - set(df.columns))
    if absent:
        raise ValueError(f"columns absent from {paths[0]}: {absent}")
    names = list(columns or df.columns)
    df = df.select(*[(null_if_missing(col(n)) if missing else col(n)).alias(n) for n in names])
    if limit is not None:
        df = df.limit(limit)
    if label in names and df.where(numeric(col(label)).isNull()).limit(1).count():
        raise ValueError(f"column {label!r} holds values that are not numbers")
    return df


def write_strings(df: DataFrame, path: str) -> None:
    """CSV that ``read_strings`` reads back cell by cell."""
    df.write.options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_keyed_parquet(spark: SparkSession, path: str, key: str = "row_key") -> DataFrame:
    """A Parquet table with a unique key made of file name and row number.

    For tables without a key of their own: the key costs no shuffle and stays
    the same for as long as the files do.
    """
    position = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    return spark.read.parquet(path).select("*", position.alias(key))


def write_benchmark(df: DataFrame, path: str, partition: str = "source_device", mode: str = "errorifexists") -> None:
    """Parquet laid out by source, so a held-out source is a pruned folder.

    Rebalancing gathers the rows of a source into files of the advisory size:
    small sources get few files, and a source holding much of the table is
    split over many tasks.
    """
    df.hint("rebalance", col(partition)).write.mode(mode).partitionBy(partition).parquet(path)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The table with its sources as text: "0" and "0.0" must not become one number."""
    setting = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return spark.read.option("basePath", path).parquet(path)
    finally:
        spark.conf.set(setting, before)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One CSV or JSON file of a report; larger tables keep their partitions."""
    small = df.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS
    one = (df.coalesce(1) if small else df).write
    one.json(path) if kind == "json" else one.option("header", True).csv(path)
