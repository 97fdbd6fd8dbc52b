"""Queries of the audit, the cleaning step and the column profile."""

from pyspark.sql import functions as F

from labelsieve.catalog import sqltext as s
from labelsieve.catalog.fixtures import (
    CATEGORICAL, LINE_COLUMNS, LINES, TRAFFIC, read, rounded, sql, view,
)
from labelsieve.functions.columns import numeric_or_zero, col
from labelsieve.operators import audit, contingency as c, duplicates, encoders, placeholders, profile
from labelsieve.sources import tables
from labelsieve.storage import scratch_path

LABEL, KEY = "Attack_label", "event_id"


def ragged_separation(spark, folder):
    """Separation in CSV files of which every tenth record has a field too many."""
    path = scratch_path(spark, "ragged")
    rows = _traffic(spark, folder)
    cells = [col(n) for n in (*CATEGORICAL, "Attack_type")]
    tables.write_strings(rows.where("event_id % 10 <> 0").select(*cells), f"{path}/whole")
    longer = [*cells[:-1], F.concat("Attack_type", F.lit(",more")).alias("Attack_type")]
    unquoted = rows.where("event_id % 10 = 0").select(*longer).write.options(header=True, quote="\u0000")
    unquoted.csv(f"{path}/ragged")
    read_back = tables.read_strings(spark, [f"{path}/whole", f"{path}/ragged"], missing=False, skip_ragged=True)
    return rounded(c.separation_any_label(read_back, CATEGORICAL, "Attack_type"))


def _traffic(spark, folder):
    return view(read(spark, folder, "events"), TRAFFIC)


def _lines(spark, folder):
    return view(read(spark, folder, "lineitem"), LINES)


def _line_counts(spark, folder):
    return c.contingency(_lines(spark, folder), LINE_COLUMNS, "y")


def audit_summary(spark, folder):
    report = audit.audit_columns(_traffic(spark, folder), CATEGORICAL, LABEL, KEY)
    return rounded(audit.audit_summary(report))


def canonicalise_report(spark, folder):
    report = placeholders.canonicalise_report(_lines(spark, folder), LINE_COLUMNS)
    return report.withColumn("spellings", F.array_join("spellings", "|"))


def numeric_block(spark, folder):
    df = _traffic(spark, folder)
    names = ["tcp.len", "mbtcp.len", "mbtcp.unit_id", "mqtt.conack.flags", "http.request.method"]
    return df.select("event_id", *[numeric_or_zero(col(n)).alias(n) for n in names])


def deduplicate(spark, folder):
    df = view(read(spark, folder, "lineitem"), {k: LINES[k] for k in ("y", "returnflag", "discount", "mixed")})
    return duplicates.deduplicate(df)


def duplicate_statistics(spark, folder):
    df = view(read(spark, folder, "lineitem"), {k: LINES[k] for k in ("y", "returnflag", "discount", "mixed")})
    return rounded(duplicates.duplicate_statistics(df, ("y",)))


def onehot(spark, folder):
    df = _lines(spark, folder)
    names = ("returnflag", "mixed")
    levels = profile.low_cardinality_levels(df, names)
    # No row key: rows with equal codes are counted together.
    dummies = df.select(*[e for n in names for e in encoders.onehot(n, levels[n])])
    return dummies.groupBy(*[F.col(f"`{n}`") for n in dummies.columns]).agg(F.count("*").alias("n"))


#: Columns of long or many tokens: table, view, audited columns, key.
WIDE = {
    "audit_texts": (
        "documents",
        {"doc_id": "doc_id", "text": "text", "source": "source", "y": "CASE WHEN lang = 'en' THEN '1' ELSE '0' END"},
        ("text", "source"), "doc_id",
    ),
    "audit_urls": (
        "pages",
        {"page_id": "page_id", "url": "url", "html": "html", "y": "CASE WHEN length(html) % 2 = 0 THEN '1' ELSE '0' END"},
        ("url", "html"), "page_id",
    ),
    "audit_props": (
        "events",
        {"event_id": "event_id", "props": "props", "y": "CASE WHEN event_type = 'error' THEN '1' ELSE '0' END"},
        ("props",), "event_id",
    ),
}


def _wide(table, columns, audited, key):
    return lambda spark, folder: rounded(audit.audit_columns(view(read(spark, folder, table), columns), audited, "y", key))


QUERIES = {
    **{name: _wide(*parts) for name, parts in WIDE.items()},
    "audit_summary": audit_summary,
    "token_contingency": lambda spark, folder: _line_counts(spark, folder),
    "token_purity": lambda spark, folder: rounded(c.token_purity(_line_counts(spark, folder))),
    "zero_spelling": lambda spark, folder: c.zero_spelling(_line_counts(spark, folder)),
    "nmi": lambda spark, folder: rounded(c.nmi(_line_counts(spark, folder))),
    "single_column_accuracy": lambda spark, folder: rounded(
        audit.single_column_accuracy(_traffic(spark, folder), CATEGORICAL, LABEL, KEY)
    ),
    "audit_column": lambda spark, folder: rounded(
        audit.audit_column(_traffic(spark, folder), "http.referer", LABEL, KEY)
    ),
    "audit_columns": lambda spark, folder: rounded(
        audit.audit_columns(_traffic(spark, folder), (*CATEGORICAL, "not.there"), LABEL, KEY)
    ),
    "leaking_columns": lambda spark, folder: rounded(
        c.leaking_columns(c.token_purity(_line_counts(spark, folder)), 0.3)
    ),
    "separation_multiclass": lambda spark, folder: rounded(
        c.separation_any_label(_traffic(spark, folder), CATEGORICAL, "Attack_type")
    ),
    "ragged_separation": ragged_separation,
    "placeholder_label_dist": lambda spark, folder: c.placeholder_label_distribution(
        _traffic(spark, folder), CATEGORICAL, "Attack_type"
    ),
    "duplicate_statistics": duplicate_statistics,
    "deduplicate": deduplicate,
    "canonicalise": lambda spark, folder: placeholders.canonicalise(
        _traffic(spark, folder).select("event_id", *[col(n) for n in CATEGORICAL], col("mbtcp.unit_id")),
        (*CATEGORICAL, "mbtcp.unit_id"),
    ),
    "canonicalise_report": canonicalise_report,
    "numeric_block": numeric_block,
    "column_profile": lambda spark, folder: rounded(
        profile.column_profile(_lines(spark, folder), (*LINE_COLUMNS, "y"))
    ),
    "onehot": onehot,
    "encoding_agnostic": lambda spark, folder: rounded(
        encoders.encoding_agnostic(_traffic(spark, folder), CODED, LABEL, KEY)
    ),
}

_LINES = sql("lineitem", LINES)
_TRAFFIC = sql("events", TRAFFIC)
_LINE_COUNTS = s.counts(LINE_COLUMNS, _LINES, "y")
_FEW = sql("lineitem", {k: LINES[k] for k in ("y", "returnflag", "discount", "mixed")})


def _report(columns, source=_TRAFFIC, label=LABEL, key=KEY):
    return f"""WITH {s.split_counts(columns, source, label, key)},
purity AS (SELECT "column", {s.PURITY} FROM counts GROUP BY "column"),
{s.NMI}, {s.ACCURACY}, {s.ZEROS}
SELECT list_position([{', '.join(s.text(n) for n in columns)}], "column")::BIGINT AS position, *
FROM purity JOIN nmi USING ("column") JOIN accuracy USING ("column") JOIN spelling USING ("column")"""


def _separation(column_sql, where="true"):
    cells = " UNION ALL ".join(
        f"SELECT {s.text(n)} AS \"column\", {s.stripped(s.name(n))} AS token, {s.stripped('\"Attack_type\"')} AS label FROM base"
        for n in CATEGORICAL
    )
    return f"WITH base AS (SELECT * FROM ({_TRAFFIC}) WHERE {where}), long AS ({cells}) {column_sql}"


_RATES = """SELECT "column", sum(n)::BIGINT AS n_rows, sum(CASE WHEN k = 1 THEN n ELSE 0 END)::BIGINT AS rows_separated,
round(sum(CASE WHEN k = 1 THEN n ELSE 0 END) / sum(n), 6) AS separation_rate,
sum(CASE WHEN k = 1 THEN n ELSE 0 END) / sum(n) > 0.999 AS fully_separates
FROM (SELECT "column", token, count(*) AS n, count(DISTINCT label) AS k FROM long GROUP BY ALL) GROUP BY "column\""""


#: Beside the audited columns one of many tokens and one that no two rows share.
CODED = (*CATEGORICAL, "tcp.srcport", "frame.time")


def _codes(name, order):
    """Accuracy under codes in an order: unseen codes go to the nearer trained one."""
    window = f'OVER (PARTITION BY "column" ORDER BY {order}'
    return f"""{name}_ordered AS (SELECT *, n0 - test0 + n1 - test1 > 0 AS seen, n1 - test1 > n0 - test0 AS vote,
    row_number() {window}) AS code FROM counts JOIN (SELECT "column", token, min({KEY}) AS first_ FROM
      ({s.long_form(CODED, '(SELECT * FROM base)', KEY, 'nan')}) GROUP BY "column", token) USING ("column", token)),
{name}_placed AS (SELECT *, max(CASE WHEN seen THEN code END) {window} ROWS UNBOUNDED PRECEDING) AS low,
    min(CASE WHEN seen THEN code END) {window} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS high FROM {name}_ordered),
{name} AS (SELECT "column", round(sum(CASE WHEN o.vote THEN p.test1 ELSE p.test0 END) / sum(p.test0 + p.test1), 6) AS {name}
  FROM {name}_placed p JOIN {name}_ordered o USING ("column")
  WHERE o.code = CASE WHEN p.low IS NULL OR p.high - p.code < p.code - p.low THEN p.high ELSE p.low END GROUP BY "column")"""


def _single(expression, null, columns=CATEGORICAL):
    return f"""WITH {s.split_counts(columns, _TRAFFIC, LABEL, KEY, null)}, {s.ACCURACY},
merged AS (SELECT "column", n0 + n1 AS token, sum(n0) AS n0, sum(n1) AS n1, sum(test0) AS test0, sum(test1) AS test1
  FROM counts GROUP BY "column", n0 + n1),
frequency AS (SELECT "column", round(sum(CASE
    WHEN n0 - test0 + n1 - test1 = 0 THEN CASE WHEN attack THEN test1 ELSE test0 END
    WHEN n1 - test1 > n0 - test0 THEN test1 ELSE test0 END) / sum(test0 + test1), 6) AS frequency
  FROM merged JOIN train USING ("column") GROUP BY "column")
{expression}"""


_ONEHOT = {
    "returnflag": ("N", "R"),
    "mixed": ("", " 6", " 7", " nan ", "0", "0.0"),
}

ORACLES = {
    **{name: _report(audited, sql(table, columns), "y", key) for name, (table, columns, audited, key) in WIDE.items()},
    "audit_summary": f"""SELECT "column", n_tokens AS tokens, pure_normal_tokens, pure_attack_tokens, rows_separated,
separation_rate, single_column_accuracy, nmi_with_label, coalesce(is_provenance_marker, false) AS provenance_marker
FROM ({_report(CATEGORICAL)})""",
    "token_contingency": f"WITH {_LINE_COUNTS} SELECT * FROM counts",
    "token_purity": f'WITH {_LINE_COUNTS} SELECT "column", {s.PURITY} FROM counts GROUP BY "column"',
    "zero_spelling": f"WITH {_LINE_COUNTS}, {s.ZEROS} SELECT * FROM spelling WHERE rows_covered IS NOT NULL",
    "nmi": f"WITH {_LINE_COUNTS}, {s.NMI} SELECT * FROM nmi",
    "single_column_accuracy": _single("SELECT * FROM accuracy", "<NA>"),
    "audit_column": f"SELECT * REPLACE (1::BIGINT AS position) FROM ({_report(CATEGORICAL)}) WHERE \"column\" = 'http.referer'",
    "audit_columns": _report(CATEGORICAL),
    "leaking_columns": f"""SELECT "column", separation_rate FROM (WITH {_LINE_COUNTS}
SELECT "column", {s.PURITY} FROM counts GROUP BY "column") WHERE separation_rate >= 0.3""",
    "separation_multiclass": _separation(_RATES),
    "ragged_separation": _separation(_RATES, "event_id % 10 <> 0"),
    "placeholder_label_dist": _separation(
        """SELECT "column", token, label, count(*) AS n,
count(*) OVER (PARTITION BY "column", token) = 1 AS single_label
FROM long WHERE token IN ('0', '0.0') GROUP BY "column", token, label"""
    ),
    "duplicate_statistics": f"""WITH base AS ({_FEW}),
sizes AS (SELECT (SELECT count(*) FROM base) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM base)) AS rows_,
  (SELECT count(*) FROM (SELECT DISTINCT returnflag, discount, mixed FROM base)) AS features)
SELECT n AS n_rows, n - rows_ AS exact_duplicate_rows, round((n - rows_) / n, 6) AS exact_duplicate_rate,
n - features AS feature_duplicate_rows, round((n - features) / n, 6) AS feature_duplicate_rate,
rows_ - features AS contradictory_duplicate_rows FROM sizes""",
    "deduplicate": f"SELECT DISTINCT * FROM ({_FEW})",
    "canonicalise": f"""SELECT event_id, {', '.join(f'{s.canonical(s.name(n))} AS {s.name(n)}' for n in (*CATEGORICAL, 'mbtcp.unit_id'))}
FROM ({_TRAFFIC})""",
    "canonicalise_report": " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count(*) FILTER (WHERE {s.in_placeholders(n)}) AS replacements,
coalesce(string_agg(DISTINCT {s.stripped(n)}, '|' ORDER BY {s.stripped(n)}) FILTER (WHERE {s.in_placeholders(n)}), '') AS spellings,
count(*) FILTER (WHERE {s.in_placeholders(n)}) > 0 AS affected,
count(DISTINCT CASE WHEN {s.in_placeholders(n)} THEN {s.stripped(n)} END) > 1 AS ambiguous FROM ({_LINES})"""
        for n in LINE_COLUMNS
    ),
    "numeric_block": "SELECT event_id, " + ", ".join(
        f"{s.number_or_zero(s.name(n))} AS {s.name(n)}"
        for n in ("tcp.len", "mbtcp.len", "mbtcp.unit_id", "mqtt.conack.flags", "http.request.method")
    ) + f" FROM ({_TRAFFIC})",
    "column_profile": " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", round(count({s.number(n)}) / count(*), 6) AS parse_rate,
count(DISTINCT {n}) + max(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM ({_LINES})"""
        for n in (*LINE_COLUMNS, "y")
    ),
    "onehot": "SELECT *, count(*) AS n FROM (SELECT " + ", ".join(
        f"CASE WHEN {n} = {s.text(v)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {s.name(f'{n}_{v}')}"
        for n, values in _ONEHOT.items() for v in values
    ) + f" FROM ({_LINES})) GROUP BY ALL",
    "encoding_agnostic": _single(
        f""", {_codes("label", "first_")}, {_codes("ordinal", "token")}
SELECT "column", single_column_accuracy AS onehot, label, ordinal, frequency,
  least(single_column_accuracy, label, ordinal, frequency) AS minimum
FROM accuracy JOIN frequency USING ("column") JOIN label USING ("column") JOIN ordinal USING ("column")""", "nan", CODED,
    ),
}
