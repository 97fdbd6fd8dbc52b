"""Queries of the preparation protocols, the benchmark build and the stream."""

from pyspark.sql import functions as F

from labelsieve.catalog import sqltext as s
from labelsieve.catalog.audits import _TRAFFIC as TRAFFIC_SQL
from labelsieve.catalog.fixtures import (
    ATTACKS, CAPTURE, CATEGORICAL, DEVICES, LINE_COLUMNS, LINES, PROVENANCE, TRAFFIC, read, rounded, sql, view,
)
from labelsieve.constants import ABSENT, IDENTIFIER_COLUMNS, RECIPE_DROP_COLUMNS
from labelsieve.plans import benchmark, recipes
from labelsieve.sources import captures
from labelsieve.storage import join_small, materialise, scratch_path
from labelsieve.streaming import incremental, tiers

KEY = "event_id"
CONFIG = benchmark.BenchmarkConfig(max_rows_per_device=1500, max_rows_per_attack=600)
NUMBERS = ("tcp.len", "tcp.flags", "mbtcp.len", "mbtcp.unit_id")


def _table(spark, folder):
    return view(read(spark, folder, "events"), TRAFFIC).drop(KEY)


def _benchmark(spark, folder):
    df = view(read(spark, folder, "events"), TRAFFIC, CAPTURE)
    dimension = captures.catalogue(spark, captures.device_rows(DEVICES) + captures.attack_rows(ATTACKS))
    return benchmark.build_benchmark(df, dimension, CONFIG, key=KEY)


def _notes(prepare):
    def query(spark, folder):
        df = _table(spark, folder)
        return recipes.notes_frame(df, prepare(df))

    return query


def _features(prepare):
    """Prepared rows without their key: a digest the SQL does not build."""
    return lambda spark, folder: rounded(prepare(_table(spark, folder)).frame.drop(recipes.ROW_KEY))


#: Documents as a table to prepare, with whole texts as tokens; the two numbers are not null.
DOCUMENTS = {
    "doc_id": "doc_id",
    "n_chars": "n_chars",
    "http.request.method": "lang",
    "http.referer": "text",
    "mqtt.topic": "source",
    "Attack_label": "CASE WHEN lang = 'en' THEN '1' ELSE '0' END",
    "Attack_type": "source",
}
DOCUMENT_DUMMIES = tuple(name for name in CATEGORICAL if name in DOCUMENTS)


def prepare_readme_vector(spark, folder):
    """The vector form over tokens of any number: one row for each entry of a document's vector."""
    prepared = recipes.prepare_readme(view(read(spark, folder, "documents"), DOCUMENTS), vector=True)
    entries = F.map_from_arrays("v.indices", "v.values")
    rows = prepared.frame.select("Attack_label", F.unwrap_udt("features").alias("v"))
    rows = rows.select(F.coalesce(F.try_element_at(entries, F.lit(0)), F.lit(0.0)).alias("doc_id"),
                       "Attack_label", F.explode(entries).alias("slot", "weight"))
    named = prepared.levels.select("slot", "column")
    return join_small(rows, named, "slot", "left").select("doc_id", "Attack_label", "slot", "weight", "column")


def build_benchmark(spark, folder):
    return _benchmark(spark, folder)


def benchmark_recheck(spark, folder):
    return rounded(benchmark.recheck_benchmark(materialise(_benchmark(spark, folder), "benchmark"), KEY))


def streaming_audit(spark, folder):
    """The audit of order lines arriving as a stream of files."""
    pieces = scratch_path(spark, "pieces")
    view(read(spark, folder, "lineitem"), LINES).repartition(4).write.parquet(pieces)
    schema = spark.read.parquet(pieces).schema
    stream = incremental.read_pieces(spark, pieces, schema, files_per_batch=2)
    counts = scratch_path(spark, "counts")
    query = incremental.start_audit(stream, LINE_COLUMNS, "y", counts, scratch_path(spark, "offsets"))
    query.awaitTermination()
    return rounded(incremental.audit_so_far(spark, counts))


def _streamed(spark, folder):
    """Order lines as a stream of files."""
    pieces = scratch_path(spark, "pieces")
    view(read(spark, folder, "lineitem"), LINES).repartition(4).write.parquet(pieces)
    return incremental.read_pieces(spark, pieces, spark.read.parquet(pieces).schema, files_per_batch=1)


def streaming_audit_folded(spark, folder):
    """The same audit from counts that are folded by level."""
    path = scratch_path(spark, "tiers")
    stream = _streamed(spark, folder)
    tiers.start_folded_audit(stream, LINE_COLUMNS, "y", path, scratch_path(spark, "offsets"), fanout=2).awaitTermination()
    return rounded(tiers.folded_audit(spark, path))


def streaming_audit_stateful(spark, folder):
    """The same audit from totals in the state store."""
    path = scratch_path(spark, "totals")
    stream = _streamed(spark, folder)
    tiers.start_stateful_audit(stream, LINE_COLUMNS, "y", path, scratch_path(spark, "offsets")).awaitTermination()
    return rounded(tiers.stateful_audit(spark, path))


QUERIES = {
    "prepare_readme": _features(recipes.prepare_readme),
    "prepare_readme_notes": _notes(recipes.prepare_readme),
    "prepare_readme_vector": prepare_readme_vector,
    "prepare_clean": _features(recipes.prepare_clean),
    "prepare_clean_notes": _notes(recipes.prepare_clean),
    "build_benchmark": build_benchmark,
    "benchmark_recheck": benchmark_recheck,
    "streaming_audit": streaming_audit,
    "streaming_audit_folded": streaming_audit_folded,
    "streaming_audit_stateful": streaming_audit_stateful,
}

_REFERERS = ("0", "0.0", *(f"() {{ {i}; }}" for i in range(10)))
_README_LEVELS = {
    "http.request.method": (" nan ", "0", "0.0", "GET", "POST"),
    "http.referer": _REFERERS,
    "http.request.version": tuple(sorted(f"HTTP/{i}.0" for i in range(30))),
    "dns.qry.name.len": ("0", "0.0"),
    "mqtt.conack.flags": ("0", "0.0", *(f"0x{i}" for i in range(4))),
    "mqtt.protoname": ("0", "0.0", "MQTT"),
    "mqtt.topic": ("probe", "sensor"),
}
# mqtt.topic separates the labels whatever the spelling, so it is removed.
_CLEAN_LEVELS = {
    "http.request.method": ("GET", "POST", ABSENT),
    "http.referer": (*(f"() {{ {i}; }}" for i in range(10)), ABSENT),
    "dns.qry.name.len": (ABSENT,),
    "mqtt.conack.flags": (*(f"0x{i}" for i in range(4)), ABSENT),
    "mqtt.protoname": ("MQTT", ABSENT),
}
_KEPT = [c for c in TRAFFIC if c not in RECIPE_DROP_COLUMNS and c != KEY]
_RAW = f"SELECT {', '.join(s.name(c) for c in _KEPT)} FROM ({TRAFFIC_SQL})"
_README_ROWS = f"SELECT DISTINCT * FROM ({_RAW}) WHERE " + " AND ".join(f"{s.name(c)} IS NOT NULL" for c in _KEPT)
_CLEAN_ROWS = "SELECT DISTINCT " + ", ".join(
    f"{s.canonical(s.name(c))} AS {s.name(c)}" if c in CATEGORICAL else s.name(c) for c in _KEPT
) + f" FROM ({_RAW})"


def _dummies(levels):
    return [
        f"CASE WHEN {s.name(c)} = {s.text(v)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {s.name(f'{c}_{v}')}"
        for c, values in levels.items() for v in values
    ]


_HEAD = ['"Attack_label"::INTEGER AS "Attack_label"', '"Attack_type"']
_NUMERIC = [f"{s.number_or_zero(s.name(n))} AS {s.name(n)}" for n in NUMBERS]
_BUILD_COLUMNS = [
    c for c in TRAFFIC if c not in (*IDENTIFIER_COLUMNS, KEY, "Attack_label", "Attack_type")
]
_BUILD = f"""SELECT event_id, {', '.join(f'{s.canonical(s.name(c))} AS {s.name(c)}' for c in _BUILD_COLUMNS)},
"Attack_label"::INTEGER AS "Attack_label", "Attack_type", source_device, source_layer
FROM (SELECT *, count(*) OVER (PARTITION BY capture) AS n FROM ({sql('events', TRAFFIC, PROVENANCE, CAPTURE)}))
WHERE {s.unit(KEY)} < least(1.0::DOUBLE, CASE WHEN source_layer = 'adversary' THEN {CONFIG.max_rows_per_attack}
ELSE {CONFIG.max_rows_per_device} END / n)"""
_BUILD_TEXT = f"SELECT * REPLACE (\"Attack_label\"::VARCHAR AS \"Attack_label\") FROM ({_BUILD})"
_NO_KEY = ", ".join(s.name(c) for c in (*_BUILD_COLUMNS, "Attack_label", "Attack_type"))


def _note_rows(pairs):
    return " UNION ALL ".join(f"SELECT '{note}' AS note, {value} AS value" for note, value in pairs.items())


_N_README = sum(len(v) for v in _README_LEVELS.values())
_N_CLEAN = sum(len(v) for v in _CLEAN_LEVELS.values()) + 13

ORACLES = {
    "prepare_readme": f"SELECT {', '.join(_HEAD + _NUMERIC + _dummies(_README_LEVELS))} FROM ({_README_ROWS})",
    "prepare_readme_notes": _note_rows({
        "n_features": f"'{len(NUMBERS) + _N_README}'",
        "rows_in": "(SELECT count(*)::VARCHAR FROM events)",
        "rows_out": f"(SELECT count(*)::VARCHAR FROM ({_README_ROWS}))",
        "dummy_columns": f"'{','.join(CATEGORICAL)}'",
        "n_dummy_features": f"'{_N_README}'",
    }),
    "prepare_readme_vector": f"""WITH base AS (SELECT DISTINCT * FROM ({sql('documents', DOCUMENTS)})
WHERE {' AND '.join(f'{s.name(c)} IS NOT NULL' for c in DOCUMENTS)}),
entries AS (SELECT *, 0 AS slot, doc_id::DOUBLE AS weight, NULL AS "column" FROM base WHERE doc_id <> 0
UNION ALL SELECT *, 1, n_chars, NULL FROM base WHERE n_chars <> 0
{' '.join(
    f"UNION ALL SELECT *, 1 + {' + '.join(['0', *(f'(SELECT count(DISTINCT {s.name(b)}) FROM base)' for b in DOCUMENT_DUMMIES[:i])])}"
    f" + dense_rank() OVER (ORDER BY {s.name(c)}), 1.0, '{c}' FROM base"
    for i, c in enumerate(DOCUMENT_DUMMIES)
)})
SELECT doc_id::DOUBLE AS doc_id, "Attack_label"::INTEGER AS "Attack_label", slot::INTEGER AS slot, weight::DOUBLE AS weight, "column"
FROM entries""",
    "prepare_clean": f"""SELECT {', '.join(_HEAD + _NUMERIC + _dummies(_CLEAN_LEVELS))},
{s.structural(s.name('http.request.version'), 'http.request.version')} FROM ({_CLEAN_ROWS})""",
    "prepare_clean_notes": _note_rows({
        "n_features": f"'{len(NUMBERS) + _N_CLEAN}'",
        "rows_in": "(SELECT count(*)::VARCHAR FROM events)",
        "rows_out": f"(SELECT count(*)::VARCHAR FROM ({_CLEAN_ROWS}))",
        "duplicates_removed": f"(SELECT ((SELECT count(*) FROM events) - count(*))::VARCHAR FROM ({_CLEAN_ROWS}))",
        "leaking_columns_removed": "'mqtt.topic'",
        "onehot_columns": f"'{','.join(c for c in CATEGORICAL if c in _CLEAN_LEVELS)}'",
        "structural_columns": "'http.request.version'",
        "placeholder_replacements": "(SELECT (" + " + ".join(
            f"count(*) FILTER (WHERE {s.in_placeholders(s.name(c))})" for c in CATEGORICAL
        ) + f")::VARCHAR FROM ({_RAW}))",
        "ambiguous_placeholder_columns": "'dns.qry.name.len,http.referer,http.request.method,mqtt.conack.flags,mqtt.protoname'",
        "sentinel": f"'{ABSENT}'",
    }),
    "build_benchmark": _BUILD,
    "benchmark_recheck": f"""WITH {s.split_counts(CATEGORICAL, _BUILD_TEXT, 'Attack_label', KEY)},
purity AS (SELECT "column", {s.PURITY} FROM counts GROUP BY "column"),
{s.NMI}, {s.ACCURACY}, {s.ZEROS},
copies AS (SELECT (SELECT count(*) FROM base) AS n, (SELECT count(*) FROM (SELECT DISTINCT {_NO_KEY} FROM base)) AS d)
SELECT "column", n_tokens AS tokens, pure_normal_tokens, pure_attack_tokens, rows_separated, separation_rate,
single_column_accuracy, nmi_with_label, coalesce(is_provenance_marker, false) AS provenance_marker,
separation_rate >= 0.999 AS fully_separating, n - d AS exact_duplicate_rows, round((n - d) / n, 6) AS exact_duplicate_rate
FROM purity JOIN nmi USING ("column") JOIN accuracy USING ("column") JOIN spelling USING ("column"), copies""",
    **dict.fromkeys(
        ("streaming_audit", "streaming_audit_folded", "streaming_audit_stateful"),
        f"WITH {s.counts(LINE_COLUMNS, sql('lineitem', LINES), 'y')} SELECT \"column\", {s.PURITY} FROM counts GROUP BY \"column\"",
    ),
}
