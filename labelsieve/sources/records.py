"""CSV records with line breaks inside quotes, read by byte ranges.

Spark's own reader gives a file with such records to one task. Here a file is read as
lines, by as many tasks as it has byte ranges, and the lines are put together again:
a line begins a record where the number of quotes ahead of it in the file is even.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelsieve.storage import join_small, materialise

BYTE_ORDER_MARK = "\ufeff"
#: The number ``_open`` gives to the last record of a range that goes on in the next.
GOES_ON = -1


def read_records(spark: SparkSession, paths, header, *, ragged: str = "", path: str = "") -> DataFrame:
    """Records of CSV files as text columns named as in ``header``, in no order.

    Quotes must be balanced: a field that holds a quote or a line break stands in quotes, with
    quotes doubled. A file where they aren't is an error, and so is one with another header.
    Lines end in LF or CR LF, and cells keep theirs as they are; the header has no line break. Empty lines are no records. Missing
    fields are null and surplus ones are left out; ``ragged`` names a column that is not null
    for such records. ``path`` names a column for the URL of the file. Compressed files can't
    be cut and are one range each.
    """
    lines = _lines(spark, paths)
    ranges = _ranges(lines)
    records = _whole(_open(lines, ranges))
    if path:
        records = join_small(records, ranges.select("range", F.col("path").alias("path_")), "range")
    fields = [f"c{i}" for i in range(len(header))]
    schema = ", ".join([*(f"{field} string" for field in fields), "ragged string"])
    options = {
        "escape": '"', "quote": '"', "multiLine": "true", "lineSep": "\n", "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "ragged",
    }
    parsed = records.withColumn("row", F.from_csv("text", schema, options))
    names = F.array(*[F.col(f"row.{field}") for field in fields])
    same = names.eqNullSafe(F.array(*[F.lit(name) for name in header])) & F.col("row.ragged").isNull()
    other = F.raise_error(F.concat(F.lit("another header than the first file's: "), F.col("text"))).cast("boolean")
    body = parsed.where(F.when(~F.col("heads"), True).when(same, False).otherwise(other))
    extra = [F.col("row.ragged").alias(ragged)] if ragged else []
    extra += [F.col("path_").alias(path)] if path else []
    return body.select(*[F.col(f"row.{field}").alias(name) for field, name in zip(fields, header)], *extra)


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with the byte range they begin in, written: every later job must see the same ranges.

    How Spark cuts files depends on the cores it has at that moment.
    """
    scan = spark.read.option("lineSep", "\n").text(list(paths))
    unquoted = F.length(F.replace("value", F.lit('"'), F.lit("")))
    return materialise(
        scan.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begins"),
            F.monotonically_increasing_id().alias("line"), "value",
            (F.length("value") - unquoted).cast("bigint").alias("quotes"),
        ),
        "lines",
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """One row for each byte range: the quotes ahead of and up to its end, and where its first line belongs.

    ``owner`` is the last range before in which a record begins. A range that begins inside a
    record has a beginning of its own if a line follows the first one with an odd number of quotes.
    """
    odd = F.col("quotes") % 2 == 1
    sums = lines.groupBy("path", "begins").agg(
        F.sum("quotes").alias("quotes"), F.min(F.when(odd, F.col("line"))).alias("turn"), F.max("line").alias("last")
    )
    order = Window.partitionBy("path").orderBy("begins")
    ahead = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = materialise(sums.withColumn("range", F.monotonically_increasing_id()), "range-sums")
    placed = numbered.withColumn("ahead", ahead).withColumn("upto", F.col("ahead") + F.col("quotes"))
    holds = (F.col("ahead") % 2 == 0) | F.coalesce(F.col("turn") < F.col("last"), F.lit(False))
    owner = F.last(F.when(holds, F.col("range")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = placed.select(
        "path", "begins", "range", "ahead", "upto", owner.alias("owner"), (F.row_number().over(order) == 1).alias("leads")
    )
    ranges = materialise(ranges, "ranges")
    unbalanced = ranges.groupBy("path").agg(F.sum(F.col("upto") - F.col("ahead")).alias("n")).where("n % 2 = 1").first()
    if unbalanced:
        raise ValueError(f"quotes are not balanced in {unbalanced.path}")
    return ranges


def _open(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines with the number of their record within the range.

    The last record of a range that ends inside it is ``GOES_ON``; lines that end a record of an
    earlier range are put under that range and number.
    """
    within = Window.partitionBy("range").orderBy("line")
    ahead = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = join_small(lines, ranges, ["path", "begins"]).drop("path", "begins")
    placed = placed.withColumn("starts", ((F.col("ahead") + ahead) % 2 == 0).cast("bigint"))
    placed = placed.withColumn("record", F.sum("starts").over(within)).withColumn(
        "records", F.max("record").over(Window.partitionBy("range"))
    )
    inherited = F.col("record") == 0
    goes_on = (F.col("record") == F.col("records")) & (F.col("upto") % 2 == 1)
    return placed.select(
        F.when(inherited, F.col("owner")).otherwise(F.col("range")).alias("range"),
        F.when(inherited | goes_on, F.lit(GOES_ON)).otherwise(F.col("record")).alias("record"),
        (F.col("leads") & (F.col("record") == 1)).alias("heads"),
        "line", "value",
    )


def _whole(opened: DataFrame) -> DataFrame:
    """Records put together from their lines; only those that go on over ranges are shuffled once more."""
    def joined(part: DataFrame) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda one: one["value"])
        return part.groupBy("range", "record").agg(F.array_join(ordered, "\n").alias("text"), F.max("heads").alias("heads"))

    records = joined(opened.where(F.col("record") != GOES_ON)).unionByName(joined(opened.where(F.col("record") == GOES_ON)))
    text = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    records = records.withColumn("text", text)
    marked = F.col("heads") & F.startswith("text", F.lit(BYTE_ORDER_MARK))
    return records.withColumn("text", F.when(marked, F.expr("substring(text, 2)")).otherwise(F.col("text"))).where("text <> ''")
