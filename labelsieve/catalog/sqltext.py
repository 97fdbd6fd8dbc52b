"""Pieces of the checking SQL used by several queries."""

from labelsieve.constants import PLACEHOLDERS, RANDOM_SEED
from labelsieve.functions.columns import WHITESPACE

NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*|\s*[+-]?(?i:inf|infinity)\s*"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def name(value: str) -> str:
    return '"' + value.replace('"', '""') + '"'


def strip(expression: str) -> str:
    return f"trim({expression}, {text(WHITESPACE)})"


def stripped(expression: str) -> str:
    return f"coalesce({strip(expression)}, '')"


def in_placeholders(expression: str) -> str:
    return f"{stripped(expression)} IN ({', '.join(text(p) for p in PLACEHOLDERS)})"


def canonical(expression: str) -> str:
    return f"CASE WHEN {in_placeholders(expression)} THEN '__absent__' ELSE {expression} END"


def number(expression: str) -> str:
    return f"CASE WHEN regexp_full_match({expression}, '{NUMBER}') THEN TRY_CAST(trim({expression}) AS DOUBLE) END"


def number_or_zero(expression: str) -> str:
    return f"coalesce({number(expression)}, 0.0::DOUBLE)"


def digest(key: str, seed=RANDOM_SEED) -> str:
    return f"md5('{seed}:' || {key})"


def unit(key: str, seed=RANDOM_SEED) -> str:
    return f"(('0x' || substr({digest(key, seed)}, 1, 12))::BIGINT / {16**12}::DOUBLE)"


def long_form(columns, table: str, keep: str, null: str = "<NA>") -> str:
    """One (column, token) row per cell of ``columns``."""
    return " UNION ALL ".join(
        f"SELECT {text(c)} AS \"column\", coalesce({name(c)}, '{null}') AS token, {keep} FROM {table}"
        for c in columns
    )


def counts(columns, base: str, label: str, null: str = "<NA>") -> str:
    """CTEs base, long, counts with n0 and n1."""
    return f"""base AS ({base}),
long AS ({long_form(columns, 'base', f'{name(label)} AS y', null)}),
counts AS (SELECT "column", token, count(*) FILTER (WHERE y = '0') AS n0,
  count(*) FILTER (WHERE y = '1') AS n1 FROM long GROUP BY "column", token)"""


def split_counts(columns, base: str, label: str, key: str, null: str = "<NA>", share: str = "0.2") -> str:
    """The same with the held-out counts test0 and test1."""
    return f"""source AS ({base}),
base AS (SELECT *, row_number() OVER (PARTITION BY {name(label)} ORDER BY {digest(key)})
  <= round(count(*) OVER (PARTITION BY {name(label)}) * {share}) AS test_ FROM source),
long AS ({long_form(columns, 'base', f'{name(label)} AS y, test_', null)}),
counts AS (SELECT "column", token, count(*) FILTER (WHERE y = '0') AS n0,
  count(*) FILTER (WHERE y = '1') AS n1,
  count(*) FILTER (WHERE y = '0' AND test_) AS test0,
  count(*) FILTER (WHERE y = '1' AND test_) AS test1 FROM long GROUP BY "column", token)"""


PURITY = """sum(n0 + n1)::BIGINT AS n_rows, count(*) AS n_tokens,
  count(*) FILTER (WHERE n1 = 0 AND n0 > 0) AS pure_normal_tokens,
  count(*) FILTER (WHERE n0 = 0 AND n1 > 0) AS pure_attack_tokens,
  sum(CASE WHEN n1 = 0 THEN n0 WHEN n0 = 0 THEN n1 ELSE 0 END)::BIGINT AS rows_separated,
  round(sum(CASE WHEN n1 = 0 THEN n0 WHEN n0 = 0 THEN n1 ELSE 0 END) / sum(n0 + n1), 6) AS separation_rate,
  sum(CASE WHEN n1 = 0 THEN n0 WHEN n0 = 0 THEN n1 ELSE 0 END) = sum(n0 + n1) AS is_fully_separating"""

# Mutual information over the mean entropy, from probabilities.
NMI = """cells AS (SELECT "column", token, y, n, sum(n) OVER (PARTITION BY "column")::DOUBLE AS total,
    sum(n) OVER (PARTITION BY "column", token)::DOUBLE AS ni, sum(n) OVER (PARTITION BY "column", y)::DOUBLE AS nj
  FROM (SELECT "column", token, 0 AS y, n0 AS n FROM counts UNION ALL SELECT "column", token, 1, n1 FROM counts)),
information AS (SELECT "column", sum(CASE WHEN n > 0 THEN n / total * ln(n * total / (ni * nj)) ELSE 0 END) AS mi,
    sum(CASE WHEN n > 0 THEN -n / total * ln(ni / total) ELSE 0 END) AS ht,
    sum(CASE WHEN n > 0 THEN -n / total * ln(nj / total) ELSE 0 END) AS hy FROM cells GROUP BY "column"),
nmi AS (SELECT "column", round(CASE WHEN ht = 0 AND hy = 0 THEN 1.0 WHEN mi <= 2.220446049250313e-16 THEN 0.0
    ELSE mi / ((ht + hy) / 2) END, 6) AS nmi_with_label FROM information)"""

ACCURACY = """train AS (SELECT "column", sum(n1 - test1) > sum(n0 - test0) AS attack FROM counts GROUP BY "column"),
accuracy AS (SELECT "column", round(sum(CASE
    WHEN n0 - test0 + n1 - test1 = 0 THEN CASE WHEN attack THEN test1 ELSE test0 END
    WHEN n1 - test1 > n0 - test0 THEN test1 ELSE test0 END) / sum(test0 + test1), 6) AS single_column_accuracy
  FROM counts JOIN train USING ("column") GROUP BY "column")"""

ZEROS = """zeros AS (SELECT "column",
    sum(CASE WHEN token = '0' THEN n0 ELSE 0 END)::BIGINT AS string_zero_normal,
    sum(CASE WHEN token = '0' THEN n1 ELSE 0 END)::BIGINT AS string_zero_attack,
    sum(CASE WHEN token = '0.0' THEN n0 ELSE 0 END)::BIGINT AS float_zero_normal,
    sum(CASE WHEN token = '0.0' THEN n1 ELSE 0 END)::BIGINT AS float_zero_attack
  FROM counts GROUP BY "column"),
verdicts AS (SELECT *, string_zero_normal + string_zero_attack > 0 AND float_zero_normal + float_zero_attack > 0 AS testable
  FROM zeros),
spelling AS (SELECT "column", string_zero_normal, string_zero_attack, float_zero_normal, float_zero_attack,
    CASE WHEN testable THEN (string_zero_normal = 0) <> (string_zero_attack = 0)
      AND (float_zero_normal = 0) <> (float_zero_attack = 0) END AS is_provenance_marker,
    CASE WHEN testable THEN string_zero_normal + string_zero_attack + float_zero_normal + float_zero_attack END AS rows_covered
  FROM verdicts)"""

METRICS = """sides AS (SELECT model, protocol, split, label AS class, n AS support, 0 AS predicted,
    CASE WHEN label = prediction THEN n ELSE 0 END AS hits FROM confusion
  UNION ALL SELECT model, protocol, split, prediction, 0, n, 0 FROM confusion),
classes AS (SELECT model, protocol, split, class, sum(support)::DOUBLE AS support, sum(predicted)::DOUBLE AS predicted,
    sum(hits)::DOUBLE AS hits FROM sides GROUP BY ALL),
rates AS (SELECT *, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
    CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision_,
    CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1 FROM classes),
metrics AS (SELECT model, protocol, split, sum(support)::BIGINT AS n_test, sum(hits) / sum(support) AS accuracy,
    avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, avg(precision_) AS precision_macro,
    avg(recall) AS recall_macro, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted
  FROM rates GROUP BY model, protocol, split)"""


def structural(expression: str, prefix: str) -> str:
    """The thirteen structural features as select items."""
    t = f"coalesce({expression}, '')"
    spaces = r"\s\x0b\x1c-\x1f\x85\p{Z}"

    def ratio(pattern):
        return (
            f"CASE WHEN length({t}) > 0 THEN round(len(regexp_extract_all({t}, '{pattern}')) / length({t}), 6)"
            " ELSE 0.0::DOUBLE END"
        )

    def marker(characters):
        tests = " OR ".join(f"contains({t}, {text(ch)})" for ch in characters)
        return f"CASE WHEN {tests} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"

    items = {
        "length": f"length({t})::DOUBLE",
        "digit_ratio": ratio(r"\p{Nd}"),
        "alpha_ratio": ratio("[A-Za-z]"),
        "punct_ratio": ratio(rf"[^\p{{L}}\p{{N}}_{spaces}]"),
        "entropy": entropy(t),
        "has_angle_bracket": marker("<>"),
        "has_quote": marker("'\""),
        "has_path_separator": marker("/\\"),
        "has_parenthesis": marker("()"),
        "has_semicolon": marker(";"),
        "has_equals": marker("="),
        "has_dollar": marker("$"),
        "has_whitespace": marker(" \t"),
    }
    return ", ".join(f"{value} AS {name(prefix + '__' + key)}" for key, value in items.items())


def entropy(t: str) -> str:
    share = f"((length({t}) - length(replace({t}, c, ''))) / length({t}))"
    return (
        f"CASE WHEN length({t}) > 0 THEN round(list_sum(list_transform(list_distinct(string_split({t}, '')),"
        f" lambda c: -{share} * log2({share}))), 6) + 0.0 ELSE 0.0::DOUBLE END"
    )
