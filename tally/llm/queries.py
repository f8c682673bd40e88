"""The queries op1 to op10, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import chat, decontam, hilbert, hostgraph, html_main, packing, pii, quality, simhash, token_orc
from tally.llm.common import new_path, table

#: A conversation whose texts hold the template's control strings.
TRAP = r"\### Assistant: </turn> ok"
RULES: list[hostgraph.Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(trap)
    return chat.digests(chat.segments(rows))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_orc.write(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return token_orc.digests(token_orc.read(spark, path))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.found(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.placed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op10_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostgraph.judged(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontam, op2_chat, op3_quality, op4_tokens, op5_pii, op6_simhash, op7_html, op8_hilbert, op9_packing, op10_hosts)
    return {f.__name__: f for f in own}


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
q AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS quoted,
    row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of,
    lag(role) OVER w AS before
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || upper(role[1]) || role[2:] || ': ' || quoted || '</turn>') + 1) AS BIGINT) AS formatted_chars,
  coalesce(bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant')
    WHEN role = 'assistant' THEN before = 'user' ELSE false END) AND bool_or(n = of AND role = 'assistant'), false) AS valid
FROM q GROUP BY conv_id
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
s AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN s ON w.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR (n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) > 200
      AND 2 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > word_chars)
    OR 5 * (length(t) - length(replace(t, '!', ''))) > n_words) AS kept
FROM m
"""

OP7_SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x:
    trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'),
      '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_transform(blocks, lambda x: regexp_replace(x, '&amp;?', '&', 'g')), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


def oracle_sql() -> dict[str, str]:
    """op1, op4, op5, op6, op8, op9 and op10 are tested against brute force instead: alignment, tokenizers, spans with
    checks, hashes and ranks on a graph are beyond SQL."""
    return {"op2_chat": OP2_SQL, "op3_quality": OP3_SQL, "op7_html": OP7_SQL}
