"""Raw captures: one CSV per device or attack, attributed by file name."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelsieve.constants import (
    ADVERSARY_LAYER,
    ATTACK_CAPTURES,
    ATTACK_PREFIX,
    BINARY_LABEL,
    DEVICE_COLUMN,
    DEVICES,
    LAYER_COLUMN,
    MULTICLASS_LABEL,
    NORMAL_CLASS,
    SCENARIO_DEVICES,
)
from labelsieve.functions.columns import col, null_if_missing
from labelsieve.sources.records import read_records
from labelsieve.sources.tables import csv_reader, read_header, without_mark
from labelsieve.storage import join_small

STEM = "capture"


def device_rows(devices=SCENARIO_DEVICES) -> list[tuple]:
    """Catalogue rows of normal captures: stem, label, class, device, layer."""
    known = {name for name, _, _ in DEVICES}
    unknown = sorted(set(devices) - known)
    if unknown:
        raise ValueError(f"unknown devices {unknown}; expected some of {sorted(known)}")
    if not devices:
        raise ValueError("at least one device must be selected")
    return [
        (name, 0, NORMAL_CLASS, name, "actuation" if name == "Modbus" else "perception") for name in devices
    ]


def attack_rows(captures=None) -> list[tuple]:
    chosen = ATTACK_CAPTURES if captures is None else {stem: ATTACK_CAPTURES.get(stem) for stem in captures}
    unknown = sorted(stem for stem, kind in chosen.items() if kind is None)
    if unknown:
        raise ValueError(f"unknown attack captures {unknown}")
    return [(stem, 1, kind, ATTACK_PREFIX + kind, ADVERSARY_LAYER) for stem, kind in chosen.items()]


def catalogue(spark: SparkSession, rows=None) -> DataFrame:
    """The dimension table of captures, one row per file stem."""
    rows = device_rows() + attack_rows() if rows is None else rows
    schema = (
        f"{STEM} string, {BINARY_LABEL} int, {MULTICLASS_LABEL} string, "
        f"{DEVICE_COLUMN} string, {LAYER_COLUMN} string"
    )
    return spark.createDataFrame(rows, schema)


def attribute(df: DataFrame, dimension: DataFrame, stem: str = STEM) -> DataFrame:
    """Stamp rows with the label, class, device and layer of their capture.

    The dimension has one row per capture file. A row of a capture that is not
    in it ends the query with an error.
    """
    stamped = [n for n in dimension.columns if n != STEM]
    bare = df.drop(*[n for n in stamped if n in df.columns])
    named = dimension.withColumnRenamed(STEM, stem).withColumn("listed_", F.lit(True))
    joined = join_small(bare, named, stem, "left")
    message = F.concat(F.lit("no such capture in the catalogue: "), F.coalesce(col(stem), F.lit("null")))
    unknown = F.raise_error(message)
    return joined.select(
        *[
            F.when(F.col("listed_").isNull(), unknown.cast(joined.schema[n].dataType)).otherwise(col(n)).alias(n)
            if n in stamped
            else col(n)
            for n in joined.columns
            if n != "listed_"
        ]
    )


def scan_unlike_captures(spark: SparkSession, paths, **options) -> DataFrame:
    """Captures whose files have different columns: all columns by name, null where a file lacks one.

    One scan for each header there is, with the ``options`` of ``scan_captures``. ``capture`` comes last.
    """
    alike = {}
    for path in paths:
        alike.setdefault(tuple(read_header(spark, path)), []).append(path)
    scans = [scan_captures(spark, group, **options) for group in alike.values()]
    union = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), scans)
    return union.select(*[col(n) for n in union.columns if n != STEM], STEM)


def scan_captures(
    spark: SparkSession, paths, *, multiline: bool = False, by_folder: bool = False, by_ranges: bool = False
) -> DataFrame:
    """All captures in one scan, as text, with the file stem in ``capture``.

    A file with another header than the first ends the scan with an error.
    ``by_folder`` takes the name of the folder a file is in instead, after any
    ``name=``: captures written as several files each. ``by_ranges`` reads files
    with line breaks inside quotes by many tasks, ``multiline`` by one each.
    """
    header = read_header(spark, paths[0])
    if by_ranges:
        header = without_mark(header)
        scan = read_records(spark, paths, header, path="path_")
        path = F.url_decode(F.col("path_"))
    else:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        scan = csv_reader(spark, multiline).schema(schema).csv(list(paths))
        path = F.url_decode(F.col("_metadata.file_path"))
    if by_folder:
        stem = F.regexp_extract(path, r"([^/=]*)/[^/]*$", 1)
    else:
        stem = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"\.[^.]*$", "")
    return scan.select(*[null_if_missing(col(n)).alias(n) for n in header], stem.alias(STEM))
