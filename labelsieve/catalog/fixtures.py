"""Audit-shaped views of the test tables.

The tables carry no leak of their own, so each view plants what an operator
looks for. Every column is one expression, written in the SQL that Spark and
the checking database share, and used by both.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

# A labelled traffic table keyed by event_id. dns.qry.name.len spells zero
# differently per label; mqtt.topic separates the labels whatever the spelling;
# mqtt.protoname leaks by spelling and by a pure token; the http columns mix
# both labels under every token.
TRAFFIC = {
    "event_id": "event_id",
    "frame.time": "'t' || event_id",
    "tcp.srcport": "'' || (user_id + 1024)",
    "http.request.method": "CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '0.0' WHEN 2 THEN ' nan ' WHEN 3 THEN 'GET' ELSE 'POST' END",
    "http.referer": "CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN '() { ' || (user_id % 10) || '; }' WHEN user_id % 2 = 0 THEN '0' ELSE '0.0' END",
    "http.request.version": "'HTTP/' || (user_id % 30) || '.0'",
    "dns.qry.name.len": "CASE WHEN event_type = 'error' THEN '0.0' ELSE '0' END",
    "mqtt.conack.flags": "CASE WHEN event_type = 'error' THEN '0.0' WHEN event_type = 'view' THEN '0x' || (user_id % 4) ELSE '0' END",
    "mqtt.protoname": "CASE WHEN event_type = 'view' THEN 'MQTT' WHEN event_type = 'error' THEN '0.0' ELSE '0' END",
    "mqtt.topic": "CASE WHEN event_type = 'error' THEN 'probe' ELSE 'sensor' END",
    "tcp.len": "'' || (user_id % 6)",
    "tcp.flags": "CASE WHEN event_type = 'error' THEN '' || (user_id % 9 + 2) ELSE '' || (user_id % 9) END",
    "mbtcp.len": "CASE WHEN user_id % 11 = 0 THEN '0x10' WHEN event_type = 'view' THEN '' || least(round(value / 100), CAST(3 AS DOUBLE)) ELSE '1' END",
    "mbtcp.unit_id": "nullif('' || (user_id % 13), '12')",
    "Attack_label": "CASE WHEN event_type = 'error' THEN '1' ELSE '0' END",
    "Attack_type": "CASE WHEN event_type <> 'error' THEN 'Normal' WHEN user_id % 2 = 0 THEN 'DDoS_HTTP' ELSE 'XSS' END",
}
PROVENANCE = {
    "source_device": "CASE event_type WHEN 'view' THEN 'Soil_Moisture' WHEN 'click' THEN 'phValue' WHEN 'signup' THEN 'Water_Level' WHEN 'purchase' THEN 'Modbus' ELSE CASE WHEN user_id % 2 = 0 THEN 'attack:DDoS_HTTP' ELSE 'attack:XSS' END END",
    "source_layer": "CASE event_type WHEN 'error' THEN 'adversary' WHEN 'purchase' THEN 'actuation' ELSE 'perception' END",
}
CAPTURE = {
    "capture": "CASE event_type WHEN 'view' THEN 'Soil_Moisture' WHEN 'click' THEN 'phValue' WHEN 'signup' THEN 'Water_Level' WHEN 'purchase' THEN 'Modbus' ELSE CASE WHEN user_id % 2 = 0 THEN 'DDoS_HTTP_Flood_attack' ELSE 'XSS_attack' END END",
}
DEVICES = ("Soil_Moisture", "phValue", "Water_Level", "Modbus")
ATTACKS = ("DDoS_HTTP_Flood_attack", "XSS_attack")
CATEGORICAL = (
    "http.request.method", "http.referer", "http.request.version",
    "dns.qry.name.len", "mqtt.conack.flags", "mqtt.protoname", "mqtt.topic",
)

# Order lines: no row key, nulls, mixed placeholder spellings, a planted leak.
LINES = {
    "y": "CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END",
    "status": "l_linestatus",
    "returnflag": "nullif(l_returnflag, 'A')",
    "discount": "'' || l_discount",
    "origin": "CASE WHEN l_linestatus = 'F' THEN '0.0' ELSE '0' END",
    "mixed": "CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '0.0' WHEN 3 THEN ' nan ' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE ' ' || l_linenumber END",
    "part": "CASE WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN 'F' || l_partkey ELSE '' || (l_partkey % 50) END",
}
LINE_COLUMNS = ("returnflag", "discount", "origin", "mixed", "part")

# Predictions of a fixed rule: class 2 is predicted and never true, scores
# tie, and the split "solo" holds one class.
PREDICTIONS = {
    "model": "CASE WHEN user_id % 2 = 0 THEN 'tree' ELSE 'bayes' END",
    "protocol": "CASE WHEN user_id % 3 = 0 THEN 'readme' ELSE 'clean' END",
    "split": "CASE WHEN event_type = 'view' AND user_id % 7 = 0 THEN 'solo' ELSE 'fold_' || (event_id % 5) END",
    "label": "CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END",
    "prediction": "CASE WHEN value > 40 THEN 1 WHEN value > 5 THEN 0 ELSE 2 END",
    "score": "value / 1000",
}

# A labelled numeric table for model fits: a weak signal in one column, and one
# that shows only in two columns together.
NUMBERS = {
    "event_id": "event_id",
    "hour": "CAST(extract(HOUR FROM ts) AS DOUBLE)",
    "user": "CAST(user_id AS DOUBLE)",
    "shifted": "value + CASE WHEN event_type = 'error' THEN 25 ELSE 0 END",
    "parity": "CAST((user_id + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 4 AS DOUBLE)",
    "Attack_label": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    "Attack_type": "CASE WHEN event_type = 'error' THEN 'XSS' ELSE 'Normal' END",
}
NUMBER_FEATURES = ("hour", "user", "shifted", "parity")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def view(df: DataFrame, *columns: dict) -> DataFrame:
    merged = {name: text for part in columns for name, text in part.items()}
    return df.select(*[F.expr(text).alias(name) for name, text in merged.items()])


def sql(table: str, *columns: dict) -> str:
    merged = {name: text for part in columns for name, text in part.items()}
    items = ", ".join(f'{text} AS "{name}"' for name, text in merged.items())
    return f"SELECT {items} FROM {table}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles: engines add in different orders."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if kind == "double" else F.col(f"`{n}`")
            for n, kind in df.dtypes
        ]
    )
