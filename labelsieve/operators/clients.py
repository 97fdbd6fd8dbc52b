"""Deal rows to clients, evenly or along devices."""

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.constants import ATTACK_PREFIX, BINARY_LABEL, DEVICE_COLUMN, RANDOM_SEED
from labelsieve.functions.columns import binary_label, col
from labelsieve.operators.ranking import deal, hash_cuts, running_totals
from labelsieve.operators.splits import part_ends
from labelsieve.storage import materialise

#: Clients without rows that an error names.
NAMED = 20


def _check(df: DataFrame) -> None:
    for required in (DEVICE_COLUMN, BINARY_LABEL):
        if required not in df.columns:
            raise KeyError(f"the frame lacks column {required!r}")


def _client_name(prefix: str, number: Column) -> Column:
    """``prefix_00``, ``prefix_01``, …"""
    text = number.cast("string")
    padded = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return F.concat(F.lit(f"{prefix}_"), padded)


def _is_attack() -> Column:
    return col(DEVICE_COLUMN).startswith(ATTACK_PREFIX)


def _deal_attacks(df: DataFrame, key, clients: int, seed) -> DataFrame:
    """Add ``dealt_``: the client an attack row goes to, in near-equal shares."""
    cuts = hash_cuts(df.where(_is_attack()), key, part_ends(clients), seed=seed)
    return cuts.attach(df, "dealt_")


def partition_iid(df: DataFrame, n_clients: int, key, *, seed=RANDOM_SEED) -> DataFrame:
    """Add ``client``: near-equal random shares named ``client_00``, …"""
    if n_clients <= 0:
        raise ValueError(f"n_clients must be positive; got {n_clients}")
    rows = df.count()
    if n_clients > rows:
        raise ValueError(f"{n_clients} clients for {rows} rows")
    numbered = df.sparkSession.range(n_clients)
    takers = numbered.select(F.col("id").alias("part"), _client_name("client", F.col("id")).alias("client"))
    dealt = deal(df, key, takers, "client", seed=seed)
    check_partition(dealt, takers)
    return dealt


def partition_by_device(df: DataFrame, key, *, seed=RANDOM_SEED) -> DataFrame:
    """Add ``client``: the device of a normal row; attacks are dealt evenly, in the devices' order.

    The devices are a table throughout, so there may be any number of them.
    """
    _check(df)
    devices = df.where(~_is_attack()).select(col(DEVICE_COLUMN).alias("client")).distinct()
    takers = running_totals(devices.withColumn("n", F.lit(1)), "client", ["n"])
    takers = materialise(takers.select((F.col("n_upto") - 1).alias("part"), "client"), "devices")
    if takers.isEmpty():
        raise ValueError("the frame holds no normal device")
    dealt = deal(df, key, takers, "client", seed=seed, among=_is_attack())
    named = dealt.withColumn("client", F.when(_is_attack(), F.col("client")).otherwise(col(DEVICE_COLUMN)))
    check_partition(named, takers)
    return named


def partition_by_farm(df: DataFrame, farms, key, *, seed=RANDOM_SEED) -> DataFrame:
    """Add ``client``: the farm of a device; attacks are dealt evenly.

    Normal rows of a device in no farm are left out.
    """
    _check(df)
    if not farms:
        raise ValueError("at least one farm is needed")
    farm_of = {}
    for number, group in enumerate(farms):
        if not group:
            raise ValueError("a farm must have at least one device")
        for device in group:
            if device in farm_of:
                raise ValueError(f"device {device!r} is in two farms")
            farm_of[device] = number
    listed = df.where(col(DEVICE_COLUMN).isin(*farm_of)).select(col(DEVICE_COLUMN)).distinct()
    unknown = sorted(set(farm_of) - {row[0] for row in listed.collect()})
    if unknown:
        raise ValueError(f"devices not in the frame: {unknown}")
    dealt = _deal_attacks(df, key, len(farms), seed)
    number = F.when(_is_attack(), F.col("dealt_"))
    for device, farm in farm_of.items():
        number = number.when(col(DEVICE_COLUMN) == device, F.lit(farm))
    named = dealt.withColumn("client", _client_name("farm", number)).drop("dealt_")
    kept = named.where(F.col("client").isNotNull())
    check_partition(kept, [f"farm_{i:02d}" for i in range(len(farms))])
    return kept


def label_skew(df: DataFrame, label: str = BINARY_LABEL) -> DataFrame:
    """Rows, attack rate and rows per label of each client, by name."""
    y = binary_label(col(label))
    return (
        df.groupBy("client")
        .agg(
            F.count("*").alias("n_rows"),
            F.avg(y).alias("attack_rate"),
            F.count_if(y == 0).alias("n_normal"),
            F.count_if(y == 1).alias("n_attack"),
        )
        .orderBy("client")
    )


def check_partition(df: DataFrame, clients) -> None:
    """Raise unless every client has rows. ``clients`` are names, or a table of them as ``client``."""
    filled = df.select("client").distinct()
    if isinstance(clients, DataFrame):
        empty = [row[0] for row in clients.join(filled, "client", "left_anti").select("client").limit(NAMED).collect()]
        none = filled.isEmpty()
    else:
        found = {row[0] for row in filled.collect()}
        empty, none = sorted(set(clients) - found), not found
    if empty or none:
        raise ValueError(f"clients without rows: {empty}")
