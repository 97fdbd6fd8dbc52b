"""Queries of sources, samples, splits, encoders, text features and clients."""

from pyspark.sql import functions as F

from labelsieve.catalog import sqltext as s
from labelsieve.catalog.fixtures import (
    ATTACKS, CAPTURE, DEVICES, PROVENANCE, TRAFFIC, read, rounded, sql, view,
)
from labelsieve.constants import BENIGN_VALUES, INJECTION_MARKERS, NA_STRINGS, RANDOM_SEED
from labelsieve.functions.columns import col
from labelsieve.functions.text import contains_any, derive, shannon_entropy
from labelsieve.operators import alignment, clients, duplicates, encoders, splits
from labelsieve.sources import captures, tables
from labelsieve.storage import scratch_path, spread

LABEL, KEY = "Attack_label", "event_id"
FARMS = (("Soil_Moisture", "phValue"), ("Modbus",))


def _events(spark, folder):
    return read(spark, folder, "events")


def _traffic(spark, folder):
    return view(_events(spark, folder), TRAFFIC, PROVENANCE)


def string_csv_scan(spark, folder):
    """Whole documents, line breaks and quotes included, through CSV."""
    path = scratch_path(spark, "csv")
    tables.write_strings(read(spark, folder, "documents"), path)
    return tables.read_strings(spark, path, columns=["doc_id", "text", "lang", "source"], multiline=True)


def string_csv_ranges(spark, folder):
    """The same, each file read by many tasks."""
    path = scratch_path(spark, "csv")
    tables.write_strings(read(spark, folder, "documents"), path)
    return tables.read_strings(spark, path, columns=["doc_id", "text", "lang", "source"], by_ranges=True)


def capture_scan(spark, folder):
    """Events as CSV folders, one for each capture, scanned as text and attributed."""
    path = scratch_path(spark, "captures")
    rows = view(_events(spark, folder), TRAFFIC, CAPTURE)
    options = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).partitionBy("capture").csv(path)
    scanned = captures.scan_captures(spark, [f"{path}/capture={stem}" for stem in (*DEVICES, *ATTACKS)], by_folder=True)
    dimension = captures.catalogue(spark, captures.device_rows(DEVICES) + captures.attack_rows(ATTACKS))
    keyed = duplicates.occurrence_key(captures.attribute(scanned, dimension), "key_")
    return keyed.withColumn("first_copy", F.col("key_").endswith(":1")).drop("key_")


#: Columns that the files of attacks, and of devices, lack.
LACKING = {"attacks": ("frame.time", "tcp.len"), "devices": ("mqtt.topic",)}


def capture_union(spark, folder):
    """Captures of devices and attacks with different columns in one table, attributed."""
    path = scratch_path(spark, "captures")
    rows = view(_events(spark, folder), TRAFFIC, CAPTURE)
    attacked = F.col("capture").isin(*ATTACKS)
    for name, part in (("attacks", rows.where(attacked)), ("devices", rows.where(~attacked))):
        kept = part.drop(*LACKING[name], "Attack_label", "Attack_type")
        kept.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                           ignoreTrailingWhiteSpace=False).partitionBy("capture").csv(f"{path}/{name}")
    paths = [f"{path}/devices/capture={stem}" for stem in DEVICES] + [f"{path}/attacks/capture={stem}" for stem in ATTACKS]
    scanned = captures.scan_unlike_captures(spark, paths, by_folder=True)
    dimension = captures.catalogue(spark, captures.device_rows(DEVICES) + captures.attack_rows(ATTACKS))
    return captures.attribute(scanned, dimension)


def attribution_join(spark, folder):
    df = view(_events(spark, folder), {"event_id": "event_id"}, CAPTURE)
    dimension = captures.catalogue(spark, captures.device_rows(DEVICES) + captures.attack_rows(ATTACKS))
    return captures.attribute(df, dimension)


def binary_label_default(spark, folder):
    df = view(_events(spark, folder), {"event_id": "event_id", "class": FOREIGN})
    return alignment.load_target(df, "class")


def binary_label_custom(spark, folder):
    df = view(_events(spark, folder), {"event_id": "event_id", "class": FOREIGN})
    return alignment.load_target(df, "class", attack_values=("DDoS", " Background "))


FOREIGN = (
    "CASE event_type WHEN 'view' THEN ' Normal ' WHEN 'click' THEN 'BENIGN' WHEN 'error' THEN 'DDoS' "
    "WHEN 'signup' THEN 'background' ELSE nullif('' || (user_id % 2) || '.0', '1.0') END"
)


def parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "benchmark")
    tables.write_benchmark(_traffic(spark, folder), path)
    return tables.read_benchmark(spark, path).select("event_id", "source_device", "source_layer", col("tcp.flags"))


def shared_features(spark, folder):
    df = _events(spark, folder).withColumnsRenamed({"user_id": "User-ID", "value": " Value", "props": "Props.Text"})
    pairs = alignment.shared_features(df.columns, ["event_id", "user.id", "VALUE", "other"])
    return alignment.align(df, pairs, side=0)


def union_captures(spark, folder):
    left = view(_events(spark, folder), {"event_id": "event_id", "a": "event_type"}, CAPTURE)
    right = view(read(spark, folder, "orders"), {"event_id": "o_orderkey", "b": "o_orderpriority", "capture": "o_orderstatus"})
    return left.unionByName(right, allowMissingColumns=True)


def capped_sample(spark, folder):
    caps = F.when(F.col("source") == "error", 600).when(F.col("source") == "view", 10_000_000).otherwise(1500)
    sample = splits.capped_sample(_events(spark, folder), "event_type", caps, "event_id")
    return sample.select("event_id", "event_type")


def stratified_split(spark, folder):
    return splits.stratified_split(_traffic(spark, folder), KEY, LABEL).select(KEY, LABEL, "split")


def kfold_assign(spark, folder):
    folded = splits.kfold_assign(_traffic(spark, folder), KEY, LABEL, n_splits=5, n_repeats=3)
    return folded.select(KEY, "fold_0", "fold_1", "fold_2")


def lodo_split(spark, folder):
    drawn = splits.lodo_draw(_traffic(spark, folder), KEY)
    tested = F.filter(F.array(*[F.lit(d) for d in DEVICES]), lambda d: F.col("attack_drawn") | (F.col("source_device") == d))
    return drawn.select(KEY, "source_device", "attack_drawn", F.array_join(tested, ",").alias("tested_under"))


def text_features(spark, folder):
    df = spread(read(spark, folder, "documents").select("doc_id", "text"))
    return rounded(df.select("doc_id", *derive(F.col("text"), "text")))


def char_entropy(spark, folder):
    df = spread(read(spark, folder, "pages").select("page_id", "html"))
    return rounded(df.select("page_id", shannon_entropy(F.col("html")).alias("entropy")))


def injection_markers(spark, folder):
    df = read(spark, folder, "pages")
    return df.select("page_id", *[contains_any(F.col("url"), chars).alias(name) for name, chars in INJECTION_MARKERS])


def _encoded(encode, name):
    def query(spark, folder):
        df = _traffic(spark, folder).select(KEY, col("http.referer"))
        return rounded(encode(df).select(KEY, name))

    return query


def model_matrix(spark, folder):
    df = _traffic(spark, folder).drop("frame.time", "mqtt.conack.flags", "mqtt.topic", "source_layer")
    return rounded(encoders.model_matrix(df, key=KEY))


def standardise(spark, folder):
    df = view(_events(spark, folder), {"event_id": "event_id", "value": "value", "user": "CAST(user_id AS DOUBLE)", "kind": "event_type"})
    scaled = encoders.standardise(df, ("value", "user"), train=F.col("kind") != "view")
    return rounded(scaled.drop("kind"))


def _clients(partition):
    return lambda spark, folder: partition(_traffic(spark, folder)).select(KEY, "client")


def partition_by_user(spark, folder):
    """A device for every user, so that there are many."""
    df = view(_events(spark, folder), USERS)
    return clients.partition_by_device(df, KEY).select(KEY, "client")


USERS = {
    "event_id": "event_id",
    "source_device": "CASE WHEN event_type = 'error' THEN 'attack:probe' ELSE 'user_' || user_id END",
    "Attack_label": "CASE WHEN event_type = 'error' THEN '1' ELSE '0' END",
}


def label_skew(spark, folder):
    return rounded(clients.label_skew(clients.partition_by_device(_traffic(spark, folder), KEY)))


QUERIES = {
    "string_csv_scan": string_csv_scan,
    "string_csv_ranges": string_csv_ranges,
    "attribution_join": attribution_join,
    "capture_scan": capture_scan,
    "capture_union": capture_union,
    "source_counts": lambda spark, folder: splits.source_counts(read(spark, folder, "documents"), "source"),
    "binary_label_default": binary_label_default,
    "binary_label_custom": binary_label_custom,
    "parquet_roundtrip": parquet_roundtrip,
    "shared_features": shared_features,
    "union_captures": union_captures,
    "capped_sample": capped_sample,
    "subsample_n": lambda spark, folder: splits.subsample(_events(spark, folder), 3000, KEY).select(KEY, "event_type"),
    "stratified_split": stratified_split,
    "kfold_assign": kfold_assign,
    "lodo_split": lodo_split,
    "text_features": text_features,
    "char_entropy": char_entropy,
    "injection_markers": injection_markers,
    "encode_label": _encoded(lambda df: encoders.encode_label(df, "http.referer", KEY), "code"),
    "encode_ordinal": _encoded(lambda df: encoders.encode_ordinal(df, "http.referer"), "ordinal"),
    "encode_frequency": _encoded(lambda df: encoders.encode_frequency(df, "http.referer"), "frequency"),
    "model_matrix": model_matrix,
    "standardise": standardise,
    "partition_iid": _clients(lambda df: clients.partition_iid(df, 7, KEY)),
    "partition_by_device": _clients(lambda df: clients.partition_by_device(df, KEY)),
    "partition_by_user": partition_by_user,
    "partition_by_farm": _clients(lambda df: clients.partition_by_farm(df, FARMS, KEY)),
    "label_skew": label_skew,
}

_TRAFFIC = sql("events", TRAFFIC, PROVENANCE)
_ATTACK = "source_device LIKE 'attack:%'"


def _missing(column):
    return f"CASE WHEN {column} NOT IN ({', '.join(s.text(v) for v in NA_STRINGS)}) THEN {column} END AS {column}"


def _label(test):
    return f"""SELECT event_id, CASE WHEN {test} THEN 1 ELSE 0 END AS label
FROM (SELECT event_id, lower({s.strip("coalesce(c, 'nan')")}) AS v FROM ({sql('events', {'event_id': 'event_id', 'c': FOREIGN})}))"""


def _chunk(rank, size, parts):
    """Number of the near-equal part a rank falls into; larger parts first."""
    base, longer = f"({size} // {parts})", f"({size} % {parts})"
    return (
        f"CASE WHEN {rank} <= {longer} * ({base} + 1) THEN ({rank} - 1) // ({base} + 1) "
        f"ELSE {longer} + ({rank} - 1 - {longer} * ({base} + 1)) // greatest({base}, 1) END"
    )


def _fold(repeat):
    digest = s.digest(KEY, f"{RANDOM_SEED}:{repeat}")
    rank = f"row_number() OVER (PARTITION BY \"{LABEL}\" ORDER BY {digest})"
    size = f"count(*) OVER (PARTITION BY \"{LABEL}\")"
    return f"({_chunk(rank, size, 5)})::INTEGER AS fold_{repeat}"


def _dealt(parts):
    return f"""SELECT *, row_number() OVER (PARTITION BY {_ATTACK} ORDER BY {s.digest(KEY)}) AS r,
count(*) OVER (PARTITION BY {_ATTACK}) AS n FROM ({_TRAFFIC})"""


_BY_DEVICE = f"""SELECT event_id, "{LABEL}", CASE WHEN {_ATTACK}
THEN ['Modbus', 'Soil_Moisture', 'Water_Level', 'phValue'][({_chunk('r', 'n', 4)}) + 1] ELSE source_device END AS client
FROM ({_dealt(4)})"""

_REFERER = f"SELECT event_id, \"http.referer\" AS token FROM ({_TRAFFIC})"

ORACLES = {
    "string_csv_scan": f"SELECT doc_id::VARCHAR AS doc_id, {_missing('text')}, {_missing('lang')}, {_missing('source')} FROM documents",
    "string_csv_ranges": f"SELECT doc_id::VARCHAR AS doc_id, {_missing('text')}, {_missing('lang')}, {_missing('source')} FROM documents",
    "capture_scan": f"""SELECT {', '.join(_missing(s.name(c)) for c in TRAFFIC if c not in (KEY, LABEL, 'Attack_type'))},
event_id::VARCHAR AS event_id, "Attack_label"::INTEGER AS "Attack_label", "Attack_type", source_device, source_layer, capture,
true AS first_copy FROM ({sql('events', TRAFFIC, PROVENANCE, CAPTURE)})""",
    "capture_union": "SELECT " + ", ".join(
        f"CASE WHEN {'NOT ' * (c in LACKING['attacks'])}({_ATTACK}) THEN {s.name(c)} END AS {s.name(c)}"
        if c in (*LACKING["attacks"], *LACKING["devices"]) else s.name(c)
        for c in TRAFFIC if c not in (KEY, LABEL, "Attack_type")
    ) + f""", event_id, "Attack_label", "Attack_type", source_device, source_layer, capture FROM (
SELECT {', '.join(_missing(s.name(c)) for c in TRAFFIC if c not in (KEY, LABEL, 'Attack_type'))},
event_id::VARCHAR AS event_id, "Attack_label"::INTEGER AS "Attack_label", "Attack_type", source_device, source_layer, capture
FROM ({sql('events', TRAFFIC, PROVENANCE, CAPTURE)}))""",
    "attribution_join": f"""SELECT event_id, capture, "Attack_label"::INTEGER AS "Attack_label", "Attack_type", source_device, source_layer
FROM ({sql('events', TRAFFIC, PROVENANCE, CAPTURE)})""",
    "source_counts": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "binary_label_default": _label(f"v NOT IN ({', '.join(s.text(v) for v in BENIGN_VALUES)})"),
    "binary_label_custom": _label("v IN ('ddos', 'background')"),
    "parquet_roundtrip": f'SELECT event_id, source_device, source_layer, "tcp.flags" FROM ({_TRAFFIC})',
    "shared_features": 'SELECT event_id::DOUBLE AS event_id, user_id::DOUBLE AS "User-ID", value AS " Value" FROM events',
    "union_captures": f"""SELECT event_id, event_type AS a, NULL AS b, {CAPTURE['capture']} AS capture FROM events
UNION ALL SELECT o_orderkey, NULL, o_orderpriority, o_orderstatus FROM orders""",
    "capped_sample": f"""SELECT event_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE {s.unit(KEY)} < least(1.0::DOUBLE, CASE event_type WHEN 'error' THEN 600 WHEN 'view' THEN 10000000 ELSE 1500 END / n)""",
    "subsample_n": f"SELECT event_id, event_type FROM events ORDER BY {s.digest(KEY)} LIMIT 3000",
    "stratified_split": f"""SELECT event_id, "{LABEL}", CASE WHEN row_number() OVER (PARTITION BY "{LABEL}" ORDER BY {s.digest(KEY)})
<= round(count(*) OVER (PARTITION BY "{LABEL}") * 0.2) THEN 'test' ELSE 'train' END AS split FROM ({_TRAFFIC})""",
    "kfold_assign": f"SELECT event_id, {_fold(0)}, {_fold(1)}, {_fold(2)} FROM ({_TRAFFIC})",
    "lodo_split": f"""SELECT event_id, source_device, {_ATTACK} AND {s.unit(KEY)} < 0.2 AS attack_drawn,
CASE WHEN {_ATTACK} AND {s.unit(KEY)} < 0.2 THEN '{','.join(DEVICES)}'
WHEN source_device IN ({', '.join(f"'{d}'" for d in DEVICES)}) THEN source_device ELSE '' END AS tested_under
FROM ({_TRAFFIC})""",
    "text_features": f"SELECT doc_id, {s.structural('text', 'text')} FROM documents",
    "char_entropy": f"SELECT page_id, {s.entropy('html')} AS entropy FROM pages",
    "injection_markers": "SELECT page_id, " + ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(url, {s.text(ch)})" for ch in chars) + f" THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}"
        for n, chars in INJECTION_MARKERS
    ) + " FROM pages",
    "encode_label": f"""WITH base AS ({_REFERER}), tokens AS (SELECT token, (row_number() OVER (ORDER BY min(event_id)) - 1)::DOUBLE AS code
FROM base GROUP BY token) SELECT event_id, code FROM base JOIN tokens USING (token)""",
    "encode_ordinal": f"""WITH base AS ({_REFERER})
SELECT event_id, (dense_rank() OVER (ORDER BY token) - 1)::DOUBLE AS ordinal FROM base""",
    "encode_frequency": f"""WITH base AS ({_REFERER})
SELECT event_id, round(count(*) OVER (PARTITION BY token) / (SELECT count(*) FROM base), 6) AS frequency FROM base""",
    "model_matrix": "SELECT event_id, \"Attack_label\", \"Attack_type\", source_device, " + ", ".join(
        [f'{s.number_or_zero(s.name(n))} AS {s.name(n)}' for n in ("tcp.srcport", "tcp.len", "tcp.flags", "dns.qry.name.len")]
        + [
            f"CASE WHEN coalesce({s.name(n)} = {s.text(v)}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {s.name(f'{n}_{v}')}"
            for n, values in (
                ("http.request.method", (" nan ", "0", "0.0", "GET", "POST")),
                ("http.referer", ("0", "0.0", *(f"() {{ {i}; }}" for i in range(10)))),
                ("mqtt.protoname", ("0", "0.0", "MQTT")),
                ("mbtcp.len", ("0.0", "0x10", "1", "1.0", "2.0", "3.0")),
                ("mbtcp.unit_id", tuple(str(i) for i in range(12))),
            )
            for v in values
        ]
        + [s.structural(s.name("http.request.version"), "http.request.version")]
    ) + f" FROM ({_TRAFFIC})",
    "standardise": """SELECT event_id, round((value - (SELECT avg(value) FROM events WHERE event_type <> 'view'))
 / (SELECT stddev_pop(value) FROM events WHERE event_type <> 'view'), 6) + 0.0 AS value,
round((user_id - (SELECT avg(user_id) FROM events WHERE event_type <> 'view'))
 / (SELECT stddev_pop(user_id) FROM events WHERE event_type <> 'view'), 6) + 0.0 AS "user" FROM events""",
    "partition_iid": f"""SELECT event_id, 'client_' || lpad(''||({_chunk('r', 'n', 7)})::INTEGER, 2, '0') AS client
FROM (SELECT event_id, row_number() OVER (ORDER BY {s.digest(KEY)}) AS r, count(*) OVER () AS n FROM events)""",
    "partition_by_device": f"SELECT event_id, client FROM ({_BY_DEVICE})",
    "partition_by_user": f"""WITH base AS ({sql('events', USERS)}),
devices AS (SELECT client, row_number() OVER (ORDER BY client) - 1 AS part
FROM (SELECT DISTINCT source_device AS client FROM base WHERE NOT {_ATTACK})),
attacks AS (SELECT event_id, row_number() OVER (ORDER BY {s.digest(KEY)}) AS r, count(*) OVER () AS n,
(SELECT count(*) FROM devices) AS m FROM base WHERE {_ATTACK})
SELECT event_id, client FROM attacks JOIN devices ON part = {_chunk('r', 'n', 'm')}
UNION ALL SELECT event_id, source_device FROM base WHERE NOT {_ATTACK}""",
    "partition_by_farm": f"""SELECT event_id, 'farm_0' || CASE WHEN {_ATTACK} THEN ({_chunk('r', 'n', 2)})::INTEGER
WHEN source_device = 'Modbus' THEN 1 ELSE 0 END AS client FROM ({_dealt(2)}) WHERE source_device <> 'Water_Level'""",
    "label_skew": f"""SELECT client, count(*) AS n_rows, round(avg("{LABEL}"::INTEGER), 6) AS attack_rate,
count(*) FILTER (WHERE "{LABEL}" = '0') AS n_normal, count(*) FILTER (WHERE "{LABEL}" = '1') AS n_attack
FROM ({_BY_DEVICE}) GROUP BY client""",
}
