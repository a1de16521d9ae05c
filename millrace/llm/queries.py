"""The registered corpus queries: each applies one operator, with its defaults, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat_format, exact_dedup, license_scan, mixing, near_dedup, pieces, quality_crf, quality_rules, secret_scan, suffix_dedup, token_alignment, url_filters, whitening
from millrace.llm.common import scratch, ship, staged, text_of

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, PIECE_MODEL, decoded_column="decoded")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), "ids")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return (suffix_dedup.remove_repeats(_table(spark, folder, "documents"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def _transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: each in one of five marker styles, every fourth turn without a marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    other = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    name = F.when(style == 3, F.element_at(F.create_map(*map(F.lit, ("system", "context", "user", "Q", "assistant", "A"))), F.col("role"))).otherwise(F.col("role"))
    marker = (F.when(style == 0, F.concat(F.initcap(name), F.lit(": "))).when(style == 1, F.concat(F.lit("<|"), name, F.lit("|>\n")))
              .when(style == 2, F.concat(F.lit("### "), F.upper(name), F.lit(":\n"))).when(style == 3, F.concat(name, F.lit(": ")))
              .otherwise(F.concat(F.lit("["), name, F.lit("] "))))
    return conversations.withColumn("raw", F.concat(F.when(other == 0, "").otherwise(F.coalesce(marker, F.lit(""))), F.coalesce("text", F.lit(""))))


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Roles and canonical turns of raw transcripts made of all conversations; the model is counted on one half of them.

    ``right``: the role of the piece's first line is the one that the table states."""
    raw = _transcripts(_table(spark, folder, "conversations"))
    training = F.pmod(F.xxhash64(F.lit("fold"), "conv_id"), F.lit(2)) == 0
    model = chat_format.train(raw.where(training), "conv_id", "turn", "raw", "role")
    parsed = chat_format.parse(raw, model, "conv_id", "turn", "raw")
    stated = raw.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return (parsed.join(stated, (F.col("transcript").eqNullSafe(F.col("conv_id"))) & F.col("place").eqNullSafe(F.col("turn")))
            .select("conv_id", "turn", "role", F.col("line_roles")[0].alias("parsed_role"),
                    (F.col("line_roles")[0] == F.col("role")).alias("right"),
                    F.coalesce(F.pmod(F.xxhash64(F.lit("fold"), "conv_id"), F.lit(2)) == 1, F.lit(True)).alias("held_out"),
                    F.size("line_roles").cast("bigint").alias("n_lines"), "rendered"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(_table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_table(spark, folder, "documents"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def quality_rules_base(spark: SparkSession, folder: str) -> DataFrame:
    """The countable columns of op7, which SQL can express."""
    return op7_quality_rules(spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op8_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    field = quality_crf.train(docs, _table(spark, folder, "labels"))
    return quality_crf.score(docs, field).select("doc_id", quality_crf.held_out().alias("held_out"), "score", "predicted")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.verdicts(_table(spark, folder, "documents"))


def exact_dedup_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches against one index: all documents; all of them again in other writing, with the pages' HTML; the benchmark's
    passages and that HTML once more, after a compaction. Verdicts of the second and third: the index knows what came before."""
    docs, pages = _table(spark, folder, "documents"), _table(spark, folder, "pages")
    shifted = docs.select((F.col("doc_id") + 10 ** 12).alias("doc_id"), F.concat(F.lit("\t "), text_of(), F.lit(" \n")).alias("text"))
    html = pages.select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    passages = _table(spark, folder, "benchmark").select((F.col("item_id") + 2 * 10 ** 12).alias("doc_id"), "text")
    index, buckets = exact_dedup.new_index(spark)
    with scratch(spark):
        staged(exact_dedup.verdicts(docs, index, buckets), "batch")
        second = staged(exact_dedup.verdicts(shifted.unionByName(html), index, buckets), "batch-verdicts", lasting=True)
        exact_dedup.compact_index(spark, index, buckets)
        third = staged(exact_dedup.verdicts(passages.unionByName(html), index, buckets), "batch-verdicts", lasting=True)
    return second.withColumn("batch", F.lit(2)).unionByName(third.withColumn("batch", F.lit(3)))


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.groups(_table(spark, folder, "documents"))


def op11_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts over all pages; ``pattern`` names the general rule where no listed one decides."""
    return url_filters.judge(_table(spark, folder, "pages"), url_filters.rule_table(spark, url_filters.compiled()))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(_table(spark, folder, "embeddings"))
    # Beyond a long the sum is NULL here; the operator's own column is a decimal.
    return white.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = token_alignment.align(_table(spark, folder, "documents"), BYTE_VOCABULARY, PIECE_MODEL, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


_MIX_SQL = r"""
WITH units AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS shuffled,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sized AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM units GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((source_no - 1) % 3 + 1)::INT] AS weight, (sum(source_size) OVER ())::DOUBLE AS budget FROM sized),
dry AS (
  SELECT *, (sum(source_size * 3) OVER o - source_size * 3)::DOUBLE AS dry_before,
         (sum(weight) OVER () - sum(weight) OVER o + weight)::DOUBLE AS weight_left
  FROM weighed WINDOW o AS (ORDER BY source_size * 3 / weight, source_no)),
levels AS (
  SELECT *, max(CASE WHEN (budget - dry_before) / weight_left <= source_size * 3 / weight
                     THEN (budget - dry_before) / weight_left END) OVER () AS level FROM dry),
targets AS (
  SELECT source, source_no, weight, source_size, budget,
         CASE WHEN level IS NULL THEN (source_size * 3)::DOUBLE
              ELSE least((source_size * 3)::DOUBLE, level * weight) END AS target FROM levels),
sent AS (
  SELECT u.doc_id, u.size, u.shuffled, t.*, (sum(u.size) OVER (PARTITION BY t.source_no ORDER BY u.shuffled, u.doc_id
         ROWS UNBOUNDED PRECEDING))::BIGINT AS before
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (pass * source_size + before)::DOUBLE / weight AS finish
  FROM sent, (SELECT unnest([0, 1, 2]) AS pass)),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_no, shuffled, doc_id, pass ROWS UNBOUNDED PRECEDING) AS total FROM copies)
SELECT doc_id, size, source_size, target, sum(CASE WHEN total <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM cut GROUP BY doc_id, size, source_size, target
"""

_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
lines AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""

_EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_BATCHES_SQL = r"""
WITH rows AS (
  SELECT 1 AS batch, doc_id, text FROM documents
  UNION ALL SELECT 2, doc_id + 1000000000000, chr(9) || ' ' || coalesce(text, '') || ' ' || chr(10) FROM documents
  UNION ALL SELECT 2, -1 - page_id, html FROM pages
  UNION ALL SELECT 3, item_id + 2000000000000, text FROM benchmark
  UNION ALL SELECT 3, -1 - page_id, html FROM pages),
d AS (
  SELECT batch, doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM rows),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(batch) OVER w AS first_batch,
         count(*) OVER (PARTITION BY text_sha256, batch) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY batch, n DESC, doc_id))
SELECT CAST(batch AS INTEGER) AS batch, doc_id, keep_id, group_size, batch = first_batch AND doc_id = keep_id AS kept, text_sha256
FROM g WHERE batch > 1
"""

_SUFFIX_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM d)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
marked AS (
  SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100
                           OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS fresh FROM later),
numbered AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (SELECT doc_id, span, min(s) AS b, max(s) + 100 AS e FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT spans.doc_id, b, e, substr(h, 2 * lag(e, 1, 0) OVER o + 1, 2 * (b - lag(e, 1, 0) OVER o)) AS before,
         substr(h, 2 * e + 1) AS rest, row_number() OVER (PARTITION BY spans.doc_id ORDER BY b DESC) = 1 AS is_last
  FROM spans JOIN d USING (doc_id) WINDOW o AS (PARTITION BY spans.doc_id ORDER BY b)),
cut AS (
  SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(before || CASE WHEN is_last THEN rest ELSE '' END, '' ORDER BY b) AS left_over
  FROM pieces GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

_NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END) AS s
  FROM words),
keyed AS (SELECT doc_id, s, len(s)::BIGINT AS n, md5(array_to_string(s, chr(10))) AS k FROM sets),
reps AS (SELECT min(doc_id) AS doc_id, any_value(s) AS s, any_value(n) AS n FROM keyed WHERE n > 0 GROUP BY k),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM reps),
close AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM close UNION SELECT b, a FROM close),
reach AS (
  SELECT doc_id, doc_id AS other FROM reps
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
tops AS (SELECT doc_id, min(other) AS top FROM reach GROUP BY doc_id),
named AS (
  SELECT k.doc_id, k.n, CASE WHEN k.n = 0 THEN k.doc_id ELSE min(k.doc_id) OVER (PARTITION BY k.k) END AS rep FROM keyed k)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT named.doc_id, named.n, coalesce(tops.top, named.rep) AS component_id
      FROM named LEFT JOIN tops ON named.n > 0 AND tops.doc_id = named.rep)
"""

def _url_sql() -> str:
    """Listed rules by plain text comparison, general ones by their regular expressions; every rule against every page."""
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rules = url_filters.compiled()
    listed = ", ".join(f"({text(r.action)}, {text(r.text)}, {text(r.text.split('/', 1)[0])}, {text('/' + r.text.split('/', 1)[1])})" for r in rules if r.listed)
    general = ", ".join(f"({text(r.action)}, {text(r.text)}, {text(r.regex)})" for r in rules if not r.listed)
    return rf"""
WITH listed(action, rule, rule_host, rule_path) AS (VALUES {listed}),
general(action, pattern, regex) AS (VALUES {general}),
rests AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
urls AS (
  SELECT n, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rests),
first_hits AS (
  SELECT n, first(rule ORDER BY len(rule) DESC, rule) AS rule, first(action ORDER BY len(rule) DESC, rule) AS action
  FROM urls JOIN listed ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
other_hits AS (
  SELECT n, first(pattern ORDER BY len(pattern) DESC, pattern) AS pattern, first(action ORDER BY len(pattern) DESC, pattern) AS action
  FROM urls JOIN general
    ON regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '#', regex) GROUP BY n)
SELECT page_id, host, path, f.rule, coalesce(f.action, o.action, 'allow') AS verdict, CASE WHEN f.rule IS NULL THEN o.pattern END AS pattern
FROM urls LEFT JOIN first_hits f USING (n) LEFT JOIN other_hits o USING (n)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_license_scan": op5_license_scan,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_rules": op7_quality_rules,
    "quality_rules_base": quality_rules_base,
    "op8_quality_crf": op8_quality_crf,
    "op9_exact_dedup": op9_exact_dedup,
    "exact_dedup_batches": exact_dedup_batches,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_alignment": op13_token_alignment,
}

# The likelihood ratio of op7 has SQL too, but its 4-grams take minutes on small tables; tests compare it with brute force.
SQL: dict[str, str] = {
    "op3_suffix_dedup": _SUFFIX_SQL,
    "op6_mix_sources": _MIX_SQL,
    "quality_rules_base": _RULES_SQL,
    "op9_exact_dedup": _EXACT_SQL,
    "exact_dedup_batches": _BATCHES_SQL,
    "op10_minhash_near_dedup": _NEAR_SQL,
    "op11_url_filters": _url_sql(),
}
