"""Counts of a stream folded by level, and the same audit on the state store.

Folded: each micro-batch adds a folder of counts of level 0. As soon as FANOUT folders of a
level are live they are added up into one of the next level, so a report over b batches reads
fewer than FANOUT folders for each of log(b) levels. Which folders are live is told by a
manifest. Each change writes a whole new manifest under the next number; one without its
success mark does not count, so a change happens as a whole or not at all. What a crash leaves
behind is never listed and never read. A replayed batch that is listed already adds nothing.

Stateful: the counts are a streaming aggregate in update mode. Each micro-batch writes the totals that
it changed; a snapshot takes the last total of each token.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from labelsieve.operators.contingency import contingency, token_purity

#: Folders of a level that are added up into one of the next.
FANOUT = 8
MANIFEST = "name string, level int, first long, last long"
COUNTS = "column string, token string, n0 long, n1 long"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


class Tiers:
    """Counts under one path. One writer at a time; readers at any time."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError(f"fanout must be at least 2; got {fanout}")
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    def manifest(self) -> tuple[int, list]:
        """The number of the last whole manifest, 0 if there is none, and its folders."""
        numbers = sorted((int(n) for n in _names(self.spark, f"{self.path}/manifest") if n.isdigit()), reverse=True)
        for number in numbers:
            if _exists(self.spark, f"{self.path}/manifest/{number}/_SUCCESS"):
                rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{number}").collect()
                return number, sorted(map(tuple, rows), key=lambda row: row[2])
        return 0, []

    def swap(self, folders: list[tuple]) -> None:
        """Make these the live folders."""
        number = self.manifest()[0] + 1
        rows = self.spark.createDataFrame(folders, MANIFEST).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")

    def write(self, counts: DataFrame) -> str:
        name = uuid.uuid4().hex
        counts.write.parquet(f"{self.path}/counts/{name}")
        return name

    def add(self, counts: DataFrame, batch: int) -> None:
        """The counts of a batch; nothing if it is in already."""
        _, live = self.manifest()
        if any(first <= batch <= last for _, _, first, last in live):
            return
        self.swap([*live, (self.write(counts), 0, batch, batch)])
        self.fold()

    def fold(self) -> None:
        """Add up full levels, lowest first."""
        while True:
            _, live = self.manifest()
            levels = sorted({row[1] for row in live})
            full = next((v for v in levels if sum(row[1] == v for row in live) >= self.fanout), None)
            if full is None:
                return
            merged = [row for row in live if row[1] == full]
            name = self.write(self._sum([row[0] for row in merged]))
            rest = [row for row in live if row[1] != full]
            self.swap([*rest, (name, full + 1, min(r[2] for r in merged), max(r[3] for r in merged))])

    def _sum(self, names: list[str]) -> DataFrame:
        parts = self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/counts/{name}" for name in names])
        return parts.groupBy("column", "token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def counts(self) -> DataFrame:
        """Contingency counts over all batches."""
        _, live = self.manifest()
        return self._sum([row[0] for row in live]) if live else self.spark.createDataFrame([], COUNTS)

    def drop_replaced(self) -> int:
        """Delete folders and manifests that are live no more; not while a reader may hold them."""
        number, live = self.manifest()
        names = {row[0] for row in live}
        gone = [f"counts/{n}" for n in _names(self.spark, f"{self.path}/counts") if n not in names]
        gone += [f"manifest/{n}" for n in _names(self.spark, f"{self.path}/manifest") if n != str(number)]
        for name in gone:
            files, place = _files(self.spark, f"{self.path}/{name}")
            files.delete(place, True)
        return len(gone)


def start_folded_audit(stream: DataFrame, columns, label: str, path: str, checkpoint: str, *, fanout=FANOUT) -> StreamingQuery:
    """Count and fold what has arrived so far, in batches, then stop; started again it goes on."""
    tiers = Tiers(stream.sparkSession, path, fanout)
    return (
        stream.writeStream.foreachBatch(lambda batch, number: tiers.add(contingency(batch, columns, label), number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def folded_audit(spark: SparkSession, path: str) -> DataFrame:
    """Separation statistics over all batches."""
    return token_purity(Tiers(spark, path).counts())


def start_stateful_audit(stream: DataFrame, columns, label: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep totals of all tokens in the state store; write those that a batch changed, then stop.

    The state grows with the different tokens. A replayed batch overwrites what it wrote.
    """

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        contingency(stream, columns, label).writeStream.outputMode("update").foreachBatch(changed)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last totals of every token."""
    changes = spark.read.schema(f"{COUNTS}, batch long").option("basePath", path).parquet(path)
    last = F.max_by(F.struct("n0", "n1"), "batch").alias("last")
    return changes.groupBy("column", "token").agg(last).select("column", "token", "last.n0", "last.n1")


def stateful_audit(spark: SparkSession, path: str) -> DataFrame:
    return token_purity(snapshot(spark, path))
