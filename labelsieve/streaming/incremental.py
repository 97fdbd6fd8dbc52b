"""Incremental audit on Structured Streaming.

Contingency counts add up, so each micro-batch only counts its own rows and
writes the counts under its batch number. A replayed batch overwrites its own
folder. No state is kept between batches; the report sums the folders.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from labelsieve.operators.contingency import contingency, token_purity

COUNTS_SCHEMA = "column string, token string, n0 long, n1 long, batch long"


def read_pieces(spark: SparkSession, path: str, schema, *, files_per_batch: int = 100, format: str = "parquet") -> DataFrame:
    """A growing folder of files as a stream, a bounded number of files at a time."""
    if files_per_batch <= 0:
        raise ValueError(f"files_per_batch must be positive; got {files_per_batch}")
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def start_audit(stream: DataFrame, columns, label: str, counts_path: str, checkpoint: str) -> StreamingQuery:
    """Count what has arrived so far, in batches, then stop.

    Started again with the same folders, it continues after the last batch.
    """

    def count_batch(batch: DataFrame, number: int) -> None:
        counts = contingency(batch, columns, label)
        counts.write.mode("overwrite").parquet(f"{counts_path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(count_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def counts_so_far(spark: SparkSession, counts_path: str) -> DataFrame:
    """Contingency counts over all batches."""
    pieces = spark.read.schema(COUNTS_SCHEMA).option("basePath", counts_path).parquet(counts_path)
    return pieces.groupBy("column", "token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def audit_so_far(spark: SparkSession, counts_path: str) -> DataFrame:
    """Separation statistics over all batches."""
    return token_purity(counts_so_far(spark, counts_path))
