"""The training-corpus pipeline: five stages over documents, each on what the one before kept.

Every stage is written as Parquet to the shared scratch folder and read again as the
next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelsieve.llm import decontamination, lines, neardup, pieces, quality
from labelsieve.llm.common import table
from labelsieve.storage import join_lookup, materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject, learnt from the labels of these documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model)
    return scored.where(F.col("quality_score") >= quality.KEEP).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines. Those of which nothing is left go."""
    deduped = lines.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return deduped.where(~emptied).withColumn("n_chars", changed).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: of the smallest doc_id, and of its texts of the smallest hash.

    Rows are told apart by doc_id and text. A doc_id that repeats with texts of different classes keeps
    one row for each class; of rows alike in both one stays. A null doc_id comes after all others.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    found = neardup.classes(docs.select("doc_id", "text"), carry={"text_hash": text})
    keys = ["doc_id", "text_hash"]
    rows = materialise(found.groupBy("root", *keys).agg(F.count("*").alias("n")), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), *keys)).alias("first")
    firsts = rows.groupBy("root").agg(first, F.count("*").alias("weight")).where("weight > 1")
    others = join_lookup(rows, materialise(firsts, "class-firsts"), "root", "weight").where("first is not null")
    others = others.where(
        ~F.col("first.doc_id").eqNullSafe(F.col("doc_id")) | (F.col("first.text_hash") != F.col("text_hash"))
    )
    others, repeats = (materialise(part.select(*keys), "row-keys") for part in (others, rows.where("n > 1")))

    def among(part: DataFrame, how: str) -> DataFrame:
        alike = F.col("d.doc_id").eqNullSafe(part["doc_id"]) & (F.col("d.__text_hash") == part["text_hash"])
        return marked.alias("d").join(part, alike, how).select("d.*")

    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn("__text_hash", text)
    marked = among(others, "left_anti")
    if repeats.isEmpty():
        return marked.select(*columns)
    one = among(repeats, "left_semi").groupBy("doc_id", "__text_hash").agg(F.first(F.struct(*columns)).alias("row"))
    return among(repeats, "left_anti").select(*columns).unionByName(one.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    row = {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    runs = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), carry=row)
    return decontamination.flagged(runs).where(~F.col("contaminated")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that is left, and whether they decode to its text."""
    encoded = pieces.encode(docs)
    return encoded.withColumn("n_pieces", F.size("ids").cast("bigint"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: Scores, SimHashes and piece ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
