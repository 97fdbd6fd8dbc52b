"""Registered queries of the training-data operators, and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelsieve.llm import (
    centroids,
    chat,
    decontamination,
    extraction,
    fingerprints,
    licenses,
    lines,
    neardup,
    negatives,
    pieces,
    quality,
    toxicity,
    vecdups,
)
from labelsieve.llm.common import held_out, table


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_edits(table(spark, folder, "documents"))


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.scan(table(spark, folder, "documents"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    encoded = pieces.encode(table(spark, folder, "documents"))
    return encoded.withColumn("n_pieces", F.size("ids").cast("bigint"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that lie in windows of benchmark items."""
    runs = decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return decontamination.flagged(runs).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.KEEP).cast("int").alias("predicted"),
    )


def op6_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of every document and the smallest document it is linked with."""
    found = neardup.classes(table(spark, folder, "documents"))
    return found.select("doc_id", neardup.hex_digits().alias("fingerprint"), "component_id")


def op7_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of lines that repeat earlier ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return model.transform(docs).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations that no longer one continues, in chat markup."""
    return chat.format_chats(table(spark, folder, "conversations"))


def op10_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    texts = extraction.extract(table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every embedding, with the inertias and the final centroids' digests."""
    return centroids.cluster(table(spark, folder, "embeddings"))


def op12_vecdups(spark: SparkSession, folder: str) -> DataFrame:
    """Links, class and representative of every embedding."""
    return vecdups.classes(table(spark, folder, "embeddings"))


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return negatives.mine(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_licenses": op2_licenses,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_neardup": op6_neardup,
    "op7_lines": op7_lines,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_extraction": op10_extraction,
    "op11_centroids": op11_centroids,
    "op12_vecdups": op12_vecdups,
    "op13_negatives": op13_negatives,
}


def _license_sql() -> str:
    rows = ", ".join(
        "('{}', '{}')".format(*(v.replace("'", "''") for v in pair))
        for pair in licenses.NOTICES.items()
    )
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    shingles = "[array_to_string(words[i:i + 4], ' ') FOR i IN range(1, greatest(len(words) - 4, 0) + 1)]"
    return rf"""
WITH templates(license, text) AS (VALUES {rows}),
parts AS (
  SELECT license, list_distinct({shingles}) AS parts
  FROM (SELECT license, {words} AS words FROM templates)),
known AS (SELECT license, parts, CAST(pow(2, ceil(log2(len(parts)))) AS INT) AS m FROM parts WHERE len(parts) > 0),
texts AS (
  SELECT * FROM (
    SELECT doc_id, {shingles} AS pieces FROM (SELECT doc_id, {words} AS words FROM documents))
  WHERE list_has_any(pieces, (SELECT flatten(list(parts)) FROM known))),
windows AS (
  SELECT doc_id, m, j * m AS skipped, pieces[j * m + 1:j * m + 2 * m] AS piece
  FROM (SELECT doc_id, pieces, m,
          unnest(range(0, greatest(CAST(ceil(len(pieces) / m) AS INT) - 2, 0) + 1)) AS j
        FROM texts CROSS JOIN (SELECT DISTINCT m FROM known) WHERE len(pieces) > 0)),
found AS (
  SELECT doc_id, license, len(list_intersect(list_distinct(piece), parts)) / len(parts) AS containment,
    [skipped + i - 1 FOR i IN range(1, len(piece) + 1) IF list_contains(parts, piece[i])] AS places
  FROM windows JOIN known USING (m) WHERE list_has_any(piece, parts))
SELECT doc_id, license, max(containment) AS containment, min(list_min(places)) AS first_word,
  max(list_max(places)) + 4 AS last_word
FROM found WHERE containment >= 0.8 GROUP BY doc_id, license
"""


_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_INTEGERS = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"


def _cluster_sql() -> str:
    # Whole numbers below 2^53, so sums of products are exact in doubles.
    square = "list_dot_product(q, q) - 2 * list_dot_product(q, c) + list_dot_product(c, c)"
    steps = []
    for step in range(centroids.ROUNDS + 1):
        steps.append(f"""a{step} AS MATERIALIZED (
  SELECT row, vec_id, q, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT row, vec_id, q, k, CAST({square} AS BIGINT) AS d FROM points CROSS JOIN c{step})
  GROUP BY row, vec_id, q)""")
        if step < centroids.ROUNDS:
            steps.append(f"""c{step + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.c, old.c) AS c FROM c{step} old LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c
    FROM (SELECT k, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n
          FROM (SELECT k, unnest(range(1, {centroids.WIDTH + 1})) AS i, unnest(q) AS x FROM a{step}) GROUP BY k, i)
    GROUP BY k) m USING (k))""")
    last = centroids.ROUNDS
    return f"""
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, {_INTEGERS} AS q FROM embeddings
  WHERE len(embedding) = {centroids.WIDTH} AND {_FINITE}),
c0 AS MATERIALIZED (
  SELECT k, q AS c FROM (
    SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id) NULLS LAST, q) - 1 AS k, q FROM points)
  WHERE k < {centroids.CLUSTERS}),
{", ".join(steps)}
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (k)
"""


ORACLES = {
    "op11_centroids": _cluster_sql(),
    "op12_vecdups": f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fit AS MATERIALIZED (
  SELECT row, vec_id, label, v FROM rows JOIN (SELECT row_number() OVER () AS row, embedding FROM embeddings) USING (row)
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE} AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.row AS a, b.row AS b FROM fit a JOIN fit b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.row <> b.row
  WHERE list_cosine_similarity(a.v, b.v) >= {vecdups.THRESHOLD}),
reached(row, root) AS (
  SELECT row, row FROM rows UNION SELECT b, root FROM reached JOIN links ON reached.row = links.a),
classes AS (
  SELECT reached.row, min(other.vec_id) AS component_id FROM reached JOIN rows other ON reached.root = other.row
  GROUP BY reached.row),
degrees AS (SELECT a AS row, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN classes USING (row) LEFT JOIN degrees USING (row)
""",
    "op13_negatives": f"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, {_INTEGERS} AS q,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
scores AS MATERIALIZED (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike,
    CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.row <> r.row AND len(a.q) = len(r.q) WHERE a.vec_id % {negatives.EVERY} = 0),
best AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scores WHERE alike),
ranked AS (
  SELECT b.anchor_id, b.vec_id AS positive_id, n.vec_id AS negative_id, b.score AS positive_score,
    n.score AS negative_score,
    row_number() OVER (PARTITION BY b.anchor, b.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM best b JOIN scores n ON b.anchor = n.anchor AND NOT n.alike
    AND {negatives.LOW} * b.score <= 100 * n.score AND 100 * n.score <= {negatives.HIGH} * b.score
  WHERE b.place <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= {negatives.NEGATIVES}
""",
    "op4_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS size,
    unnest([array_to_string(words[i:i + least(len(words), 13) - 1], ' ') FOR i IN range(1, greatest(len(words) - 12, 1) + 1)]) AS piece
  FROM item_words WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
doc_windows AS (
  SELECT doc_id, size, i AS start, array_to_string(words[i:i + size - 1], ' ') AS piece
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM doc_words CROSS JOIN sizes WHERE len(words) >= size)),
hits AS (
  SELECT doc_id, start, doc_windows.size, item_id FROM doc_windows JOIN windows
  ON doc_windows.piece = windows.piece AND doc_windows.size = windows.size),
places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(start, start + size)) AS place FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc_words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op2_licenses": _license_sql(),
    "op7_lines": r"""
WITH every AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
measured AS (
  SELECT doc_id, pos, trim(raw, ' ') AS line, len(regexp_extract_all(raw, '\S+')) AS w,
    count(*) OVER (PARTITION BY doc_id) AS n_lines FROM every),
placed AS (
  SELECT *, row_number() OVER d AS i, sum(w) OVER d AS till, sum(w) OVER d - w AS since,
    coalesce(lead(pos) OVER d, n_lines) - 1 AS end_pos
  FROM measured WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
reach AS (
  SELECT a.doc_id, a.i AS low, max(b.i) AS high FROM placed a JOIN placed b
  ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.since - a.since < 50
  GROUP BY a.doc_id, a.i HAVING max(b.till) - min(a.since) >= 50
  UNION
  SELECT a.doc_id, min(b.i), a.i FROM placed a JOIN placed b
  ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 49 AND a.i AND a.till - b.till < 50
  GROUP BY a.doc_id, a.i HAVING max(a.till) - min(b.since) >= 50),
windows AS (
  SELECT r.doc_id, low, high, string_agg(line, chr(10) ORDER BY i) AS content, min(pos) AS first_at, max(end_pos) AS last_at
  FROM reach r JOIN placed p ON r.doc_id = p.doc_id AND p.i BETWEEN low AND high
  GROUP BY r.doc_id, low, high),
ranked AS (
  SELECT *, first_value(doc_id) OVER c AS first_doc, first_value(high) OVER c AS first_high
  FROM windows WINDOW c AS (PARTITION BY content ORDER BY doc_id, low)),
doomed AS (
  SELECT DISTINCT doc_id, unnest(range(first_at, last_at + 1)) AS pos FROM ranked
  WHERE doc_id > first_doc OR (doc_id = first_doc AND low > first_high)),
kept AS (
  SELECT e.doc_id, string_agg(raw, chr(10) ORDER BY e.pos) FILTER (WHERE d.pos IS NULL) AS text,
    count(*) AS n_lines, count(d.pos) AS n_removed
  FROM every e LEFT JOIN doomed d ON e.doc_id = d.doc_id AND e.pos = d.pos GROUP BY e.doc_id)
SELECT kept.doc_id, CASE WHEN n_removed = 0 THEN documents.text ELSE coalesce(kept.text, '') END AS text,
  n_lines, n_removed
FROM kept JOIN documents USING (doc_id)
""",
    "op9_chat": r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
rolling AS (
  SELECT conv_id, row_number() OVER w AS n,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS so_far,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
whole AS (SELECT so_far, min(conv_id) AS conv_id FROM rolling WHERE n = n_turns GROUP BY so_far),
kept AS (
  SELECT conv_id FROM whole WHERE so_far NOT IN (SELECT so_far FROM rolling WHERE n < n_turns))
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |')
    || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM turns JOIN kept USING (conv_id) GROUP BY conv_id
""",
}
