"""Exact global ranks without a global sort.

Three tools. ``HashCuts`` finds the rows at given ranks of a hash order; a split
then is a comparison with those few hashes, and no row is shuffled. ``deal`` cuts
the order among any number of takers, with a table of cuts instead of literals.
``running_totals`` numbers an aggregated table along a real order, in ranges.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from labelsieve.functions.columns import col
from labelsieve.functions.hashing import hash_hex, hash_unit
from labelsieve.storage import join_small, materialise

PREFIX_DIGITS = 3
SORT_ROWS = 1_000_000
RANGE_ROWS = 500_000
INLINE_CUTS = 256
INLINE_PREFIXES = 64
#: Rows and takers of one hash prefix of a deal, on average at most.
DEALT_ROWS = 50_000
DEALT_TAKERS = 16


@dataclass(frozen=True)
class HashCuts:
    """Hashes standing at the requested ranks, per stratum."""

    key: object
    seed: object
    stratum: Column
    hashes: dict
    requested: int

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        """Add the number of cuts a row lies beyond: 0 up to the first cut.

        Hash and stratum are columns of their own, so a row is hashed once
        however many cuts it is compared with.
        """
        inputs = {"h_": hash_hex(self.key, self.seed), "s_": self.stratum}
        number = None
        for value, cuts in self.hashes.items():
            beyond = _cuts_below(F.col("h_"), cuts, self.requested - len(cuts))
            same = F.col("s_").eqNullSafe(F.lit(value))
            number = F.when(same, beyond) if number is None else number.when(same, beyond)
        number = F.lit(self.requested) if number is None else number
        return df.withColumns(inputs).withColumn(name, number).drop("h_", "s_")


def _cuts_below(h: Column, cuts: list, already: int) -> Column:
    """``already`` plus the number of sorted ``cuts`` below ``h``, by halving."""
    if not cuts:
        return F.lit(already)
    if len(cuts) > INLINE_CUTS:
        return _placed(h, cuts) + F.lit(already)
    middle = len(cuts) // 2
    return F.when(h <= F.lit(cuts[middle]), _cuts_below(h, cuts[:middle], already)).otherwise(
        _cuts_below(h, cuts[middle + 1 :], already + middle + 1)
    )


def _literal(value) -> Column:
    """A collected value as a column; a row becomes a struct."""
    if isinstance(value, Row):
        return F.struct(*[_literal(part).alias(name) for name, part in value.asDict().items()])
    return F.lit(value)


def _placed(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by halving an array of them."""
    literal = F.array(*[b if isinstance(b, Column) else F.lit(b) for b in bounds])
    state = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s: Column, _step: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        below = F.struct(s["low"].alias("low"), middle.alias("high"))
        narrower = F.when(F.get(literal, middle) < value, above).otherwise(below)
        return F.when(s["low"] < s["high"], narrower).otherwise(s)

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, state, halve, lambda s: s["low"])


def hash_cuts(df: DataFrame, key, ranks, *, seed, stratum: Column = None) -> HashCuts:
    """Find the hashes at ``ranks`` (1-based) of the order by ``md5(seed:key)``.

    ``ranks`` maps a stratum's row count, as a column, to an array of ranks; a
    rank of 0 means "before the first row".
    """
    return repeated_hash_cuts(df, key, ranks, seeds=[seed], stratum=stratum)[0]


def repeated_hash_cuts(df: DataFrame, key, ranks, *, seeds, stratum: Column = None) -> list[HashCuts]:
    """Hash cuts of several orders, found in the same scans.

    Counting hash prefixes narrows the search to the prefixes holding a wanted
    rank, once or more, until these are small enough to sort. Only
    (orders x strata x ranks) rows reach the driver.
    """
    stratum = F.lit(0) if stratum is None else stratum
    hashes = [hash_hex(key, seed) for seed in seeds]
    if len(seeds) == 1:
        hashed = df.select(stratum.alias("s"), F.lit(0).alias("i"), hashes[0].alias("h"))
    else:
        hashed = df.select(stratum.alias("s"), F.posexplode(F.array(*hashes)).alias("i", "h"))

    depth = PREFIX_DIGITS
    size = F.sum("n").over(Window.partitionBy("i", "s"))
    wanted = F.transform(
        ranks(F.col("size")), lambda r, i: F.struct(i.alias("cut"), r.cast("long").alias("rank"))
    )
    counts = (
        hashed.groupBy("i", "s", F.lit("").alias("parent"), F.substring("h", 1, depth).alias("prefix"))
        .agg(F.count("*").alias("n"))
        .withColumn("size", size)
        .withColumn("wanted", wanted)
    )
    upto = F.sum("n").over(Window.partitionBy("i", "s", "parent").orderBy("prefix"))
    rows = _at_wanted(counts.withColumn("upto", upto), F.col("upto") == F.col("n"))
    cuts = [HashCuts(key, seed, stratum, {}, max((r.k for r in rows), default=0)) for seed in seeds]
    for row in rows:
        cuts[row.i].hashes.setdefault(row.s, [])
    found = [row for row in rows if row.cut is not None]
    while found and max(row.n for row in found) > SORT_ROWS:
        depth += PREFIX_DIGITS
        if depth > 30:
            raise ValueError(f"key {key!r} is not unique: over {SORT_ROWS} rows share one value")
        inside = _inside(hashed, found)
        counts = inside.groupBy("i", "s", "parent", F.substring("h", 1, depth).alias("prefix")).agg(
            F.count("*").alias("n"), F.first("wanted").alias("wanted")
        )
        found = _at_wanted(counts.withColumn("upto", upto), F.lit(False))

    if found:
        for row in _sorted_inside(_inside(hashed, found)):
            if row.h == row.following:
                raise ValueError(f"key {key!r} is not unique")
            cuts[row.i].hashes[row.s].append((row.cut, row.h))
    for one in cuts:
        for value, pairs in one.hashes.items():
            one.hashes[value] = [h for _, h in sorted(pairs)]
    return cuts


def _at_wanted(placed: DataFrame, always: Column) -> list:
    """The prefix each wanted rank falls into, and the rank left inside it.

    Rows where ``always`` holds are returned in any case, without a cut.
    """
    before = F.col("upto") - F.col("n")
    hits = F.filter("wanted", lambda w: (w["rank"] > before) & (w["rank"] <= F.col("upto")))
    return (
        placed.select("i", "s", "prefix", "n", before.alias("before"), F.size("wanted").alias("k"),
                      always.alias("always"), hits.alias("hits"))
        .where((F.size("hits") > 0) | F.col("always"))
        .select("*", F.explode_outer("hits").alias("w"))
        .select("i", "s", "prefix", "n", "k", "w.cut", (F.col("w.rank") - F.col("before")).alias("rank"))
        .collect()
    )


def _inside(hashed: DataFrame, found) -> DataFrame:
    """Rows under the located prefixes, with what is wanted of each prefix.

    There are few prefixes, so they are part of the filter.
    """
    by_prefix = {}
    for row in found:
        by_prefix.setdefault((row.i, row.s, row.prefix), []).append(
            F.struct(F.lit(row.cut).alias("cut"), F.lit(row["rank"]).cast("long").alias("rank"))
        )
    parent = F.substring("h", 1, len(found[0].prefix))
    if len(by_prefix) > INLINE_PREFIXES:
        spark = hashed.sparkSession
        kind = hashed.schema["s"].dataType.simpleString()
        table = spark.createDataFrame(
            [(r.i, r.s, r.prefix, r.cut, r["rank"]) for r in found],
            f"i int, s {kind}, parent string, cut int, rank long",
        ).groupBy("i", "s", "parent").agg(F.collect_list(F.struct("cut", "rank")).alias("wanted"))
        return hashed.withColumn("parent", parent).join(F.broadcast(table), ["i", "s", "parent"])
    wanted = None
    for (i, value, prefix), ranks in by_prefix.items():
        same = (F.col("i") == i) & F.col("s").eqNullSafe(F.lit(value)) & (parent == prefix)
        wanted = F.when(same, F.array(*ranks)) if wanted is None else wanted.when(same, F.array(*ranks))
    prefixes = sorted({prefix for _, _, prefix in by_prefix})
    candidates = hashed.where(parent.isin(*prefixes))
    return candidates.select("*", parent.alias("parent"), wanted.alias("wanted")).where(F.col("wanted").isNotNull())


def _sorted_inside(inside: DataFrame) -> list:
    order = Window.partitionBy("i", "s", "parent").orderBy("h")
    ranked = inside.select(
        "i", "s", "h", "wanted", F.row_number().over(order).alias("r"), F.lead("h").over(order).alias("following")
    )
    hits = F.filter("wanted", lambda w: w["rank"] == F.col("r"))
    return ranked.select("i", "s", "h", "following", F.explode(hits).alias("w")).select("*", "w.cut").drop("w").collect()


def deal(df: DataFrame, key, takers: DataFrame, name: str, *, seed, among: Column = None) -> DataFrame:
    """Add ``name``: the taker a row falls to when the hash order is cut into near-equal parts.

    ``takers`` holds ``part`` (0, 1, …) and ``name``; larger parts come first. ``among`` says which
    rows are dealt; the value of others has no meaning. A lookup table tells for each hash prefix
    which takers its rows go to and from which hash on. It is joined on the prefix, so no
    taker passes through the driver and the plan is of one size for any number of them. Only
    hashes under prefixes that hold a cut are sorted, each prefix by itself.
    """
    hashed = (df if among is None else df.where(among)).select(hash_hex(key, seed).alias("h"))
    parts = takers.count()
    coarse = hashed.groupBy(F.substring("h", 1, PREFIX_DIGITS).alias("prefix")).agg(F.count("*").alias("n"))
    rows = coarse.agg(F.sum("n").alias("n")).first().n or 0
    digits = PREFIX_DIGITS
    while 16**digits < max(rows / DEALT_ROWS, parts / DEALT_TAKERS):
        digits += 1
    hashed = hashed.withColumn("prefix", F.substring("h", 1, digits))
    ranges = running_totals(hashed.groupBy("prefix").agg(F.count("*").alias("n")), "prefix", ["n"])
    ranges = ranges.select(
        "prefix", "n", (F.col("n_upto") - F.col("n")).alias("before"),
        _part_of("n_upto - n + 1", rows, parts).alias("first"), _part_of("n_upto", rows, parts).alias("last"),
    )
    ranges = materialise(ranges, "prefixes")
    if (ranges.agg(F.max("n").alias("n")).first().n or 0) > SORT_ROWS:
        raise ValueError(f"key {key!r} is not unique: over {SORT_ROWS} rows share one value")

    split = ranges.where("first < last").select("prefix", "before")
    order = Window.partitionBy("prefix").orderBy("h")
    ranked = join_small(hashed, split, "prefix").select(
        "prefix", "h", (F.col("before") + F.row_number().over(order)).alias("r"), F.lag("h").over(order).alias("ahead")
    )
    part = _part_of("r", rows, parts)
    repeated = F.raise_error(F.lit(f"key {key!r} is not unique")).cast("string")
    start = F.when(F.col("h") == F.col("ahead"), repeated).otherwise(F.col("h"))
    starts = ranked.where(F.col("ahead").isNotNull() & (part != _part_of("r - 1", rows, parts)))
    starts = starts.select("prefix", start.alias("start"), part.alias("part"))
    starts = starts.unionByName(ranges.select("prefix", F.lit("").alias("start"), F.col("first").alias("part")))
    taken = join_small(starts, takers.select("part", col(name).alias("taker")), "part")
    lookup = taken.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("start", "taker"))).alias("starts_"))
    lookup = materialise(lookup.withColumnRenamed("prefix", "prefix_"), "deal")

    h = hash_hex(key, seed)
    looked = join_small(df.withColumns({"h_": h, "prefix_": F.substring(h, 1, digits)}), lookup, "prefix_", "left")
    last = F.element_at(F.filter("starts_", lambda cut: cut["start"] <= F.col("h_")), -1)
    return looked.select(*[col(c) for c in df.columns if c != name], last["taker"].alias(name))


def _part_of(rank: str, rows: int, parts: int) -> Column:
    """Which of the near-equal parts, larger ones first, the row of a 1-based rank is in."""
    size, longer = divmod(rows, max(parts, 1))
    ahead = longer * (size + 1)
    return F.expr(
        f"CASE WHEN {rank} <= {ahead} THEN ({rank} - 1) div {size + 1} "
        f"ELSE {longer} + ({rank} - 1 - {ahead}) div {max(size, 1)} END"
    )


def running_totals(df: DataFrame, order: str, values, *, groups=()) -> DataFrame:
    """Add ``<value>_upto``: the total of ``value`` up to and including a row.

    ``order`` must be unique within a group, so aggregate first; rows of a hot
    value are then one row. Tables above ``RANGE_ROWS`` are cut into ranges of
    about that size by bounds taken from a hash sample. The bounds only set the
    balance; the totals are exact wherever they lie.
    """
    groups = list(groups)
    df = materialise(df, "ordered")
    n = df.count()
    if n <= RANGE_ROWS:
        within = Window.partitionBy(*groups).orderBy(order)
        return df.select("*", *[F.sum(v).over(within).alias(f"{v}_upto") for v in values])

    bounds = _range_bounds(df, order, groups, n)
    kind = dict(df.dtypes)[order]
    bounds = [_literal(b).cast(kind) for b in bounds]
    ranged = df.withColumn("range_", _placed(F.col(order), bounds) if bounds else F.lit(0))
    ahead = Window.partitionBy(*groups).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*groups, "range_")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(
            *groups, "range_",
            *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"{v}_before") for v in values],
        )
    )
    within = Window.partitionBy(*groups, "range_").orderBy(order)
    joined = join_small(ranged, offsets, [*groups, "range_"])
    return joined.select(
        *df.columns,
        *[(F.sum(v).over(within) + F.col(f"{v}_before")).alias(f"{v}_upto") for v in values],
    )


def _range_bounds(df: DataFrame, order: str, groups, n: int) -> list:
    """Values splitting the order into ranges, from about 32 samples a range, 2,048 ranges at most.

    A row is drawn by its group and value, so the rows of a common value are drawn one by one.
    """
    ranges = min(-(-n // RANGE_ROWS), 2048)
    sample = (
        df.where(hash_unit([*groups, order], "range-bounds") < 32 * ranges / n).select(order).orderBy(order).collect()
    )
    values = [row[0] for row in sample if row[0] is not None]
    step = max(len(values) // ranges, 1)
    return list(dict.fromkeys(values[step::step]))  # in Spark's order, which that of rows with nulls is not in Python
