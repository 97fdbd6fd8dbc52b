"""Where intermediate results go, and joins with small tables.

An intermediate result that several jobs read is written as Parquet to the
cluster's shared checkpoint folder: it outlives a lost executor, cuts the
lineage, and later readers still prune columns.
"""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def scratch_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="labelsieve-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "frame") -> DataFrame:
    """Write the frame to the scratch folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core: a small table may sit in one file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits_broadcast(table: DataFrame) -> bool:
    """Whether a table is small enough to send to every executor.

    Counts at most one row more than the bound, so a large table is not read
    to the end.
    """
    width = sum(
        (
            F.coalesce(F.length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
            for f in table.schema.fields
        ),
        F.lit(0),
    )
    size = (
        table.select(width.alias("w"))
        .limit(BROADCAST_ROWS + 1)
        .agg(F.count("*").alias("n"), F.sum("w").alias("b"))
        .first()
    )
    return size.n <= BROADCAST_ROWS and (size.b or 0) <= BROADCAST_BYTES


def join_small(df: DataFrame, table: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a table expected to be small, broadcast only if it is."""
    return df.join(F.broadcast(table) if fits_broadcast(table) else table, on, how)


HOT_SHARE = 1000


def join_lookup(df: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join with a lookup table keyed on a possibly skewed key.

    ``weight`` counts the rows of ``df`` under each key. A table within the
    broadcast bound is broadcast. Beyond it, keys holding more than one
    thousandth of all rows are looked up by broadcast: there are at most a
    thousand of them, whatever the data. The rest cannot be skewed and are
    joined by shuffle.
    """
    payload = table.drop(weight)
    if fits_broadcast(payload):
        return df.join(F.broadcast(payload), key, "left")
    total = table.agg(F.sum(weight).alias("n")).first().n
    hot = table.where(F.col(weight) > total / HOT_SHARE).drop(weight)
    hot_keys = F.broadcast(hot.select(key))
    hot_rows = df.join(F.broadcast(hot), key)
    cold_rows = df.join(hot_keys, key, "left_anti").join(payload, key, "left")
    return hot_rows.unionByName(cold_rows)
