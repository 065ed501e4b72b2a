"""Queries of the language-model text problems and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import conversations, leaks, sentences, tokens


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every message of every whole conversation, in order, with its prompt."""
    return conversations.rebuild_conversations(_table(spark, sf, "session_lines"))


def p1_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The same messages with their content, block by block."""
    return conversations.rebuild_conversations(_table(spark, sf, "session_lines"), content=True)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_corpus(_table(spark, sf, "documents").select("doc_id", "text"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with every held-out item that it leaks."""
    return leaks.leaked_items(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the length of the longest shared run and of the document, in tokens."""
    return leaks.leak_spans(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without their leaked spans."""
    return leaks.remove_leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.sentence_units(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_messages, p6_ids, p7_found, p7_spans, p7_clean, p8_found)}

ORACLES = {
    "p1_found": """
WITH parsed AS (
    SELECT session_id AS s, line_type, epoch_us(CAST(ts AS TIMESTAMPTZ)) AS us, COALESCE(json_extract_string(message, '$.id'), '') AS mid, line_id, json_extract(message, '$.content') AS c
    FROM session_lines
    WHERE session_id IS NOT NULL AND session_id <> '' AND line_type IN ('user', 'assistant') AND NOT COALESCE(is_meta, false) AND NOT COALESCE(is_compact_summary, false)
      AND NOT COALESCE(is_sidechain, false) AND message IS NOT NULL AND json_valid(message)
), blocks AS (
    SELECT line_id, c AS b FROM parsed WHERE json_type(c) IN ('OBJECT', 'VARCHAR')
    UNION ALL SELECT line_id, UNNEST(json_extract(c, '$[*]')) FROM parsed WHERE json_type(c) = 'ARRAY'
), facts AS (
    SELECT line_id, BOOL_OR(json_extract_string(b, '$.type') = 'tool_result') AS is_tool,
           BOOL_OR(regexp_matches(CASE WHEN json_type(b) = 'VARCHAR' THEN b ->> '$' WHEN json_extract_string(b, '$.type') = 'text' THEN json_extract_string(b, '$.text') END, '\\S')) AS has_text,
           list(json_extract_string(b, '$.id')) FILTER (json_extract_string(b, '$.type') = 'tool_use') AS uses,
           list(COALESCE(json_extract_string(b, '$.tool_use_id'), '')) FILTER (json_extract_string(b, '$.type') = 'tool_result') AS results
    FROM blocks GROUP BY line_id
), msgs AS (
    SELECT s, CASE WHEN mid = '' THEN concat('?', us, line_type, CAST(c AS VARCHAR)) ELSE mid END AS k, MIN(mid) AS mid, MIN(us) AS us, MIN(line_type) AS line_type,
           COALESCE(BOOL_OR(is_tool), false) AS is_tool, COALESCE(BOOL_OR(has_text), false) AS has_text, flatten(list(uses)) AS uses, flatten(list(results)) AS results
    FROM parsed LEFT JOIN facts USING (line_id) GROUP BY ALL
), used AS (SELECT DISTINCT s, k, us, UNNEST(uses) AS ref FROM msgs), answered AS (SELECT DISTINCT s, k, us, UNNEST(results) AS ref FROM msgs),
broken AS (
    SELECT a.s FROM answered a WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.s = a.s AND u.ref = a.ref AND u.us <= a.us AND u.k <> a.k)
    UNION SELECT u.s FROM used u WHERE NOT EXISTS (SELECT 1 FROM answered a WHERE u.s = a.s AND u.ref = a.ref)
), ordered AS (
    SELECT *, row_number() OVER w AS n, line_type = 'user' AND NOT is_tool AS is_prompt, SUM(CASE WHEN line_type = 'user' AND NOT is_tool THEN 1 ELSE 0 END) OVER w AS p
    FROM msgs WINDOW w AS (PARTITION BY s ORDER BY us, is_tool, k)
), turns AS (
    SELECT s, p, MIN(n) AS first_n, MAX(CASE WHEN is_prompt THEN mid END) AS prompt_id, BOOL_OR(is_prompt AND has_text) AS spoken,
           BOOL_OR(NOT is_prompt AND NOT is_tool AND line_type = 'assistant' AND has_text) AS replied FROM ordered GROUP BY ALL
), kept AS (
    SELECT s FROM turns GROUP BY s HAVING MIN(p) > 0 AND BOOL_AND(replied) AND BOOL_OR(spoken)
)
SELECT o.s AS session_id, t.prompt_id, CAST(o.n - t.first_n AS BIGINT) AS step_no, CASE WHEN o.is_tool THEN 'tool' ELSE o.line_type END AS speaker, o.mid AS message_id
FROM ordered o JOIN turns t ON o.s = t.s AND o.p = t.p WHERE o.s IN (SELECT s FROM kept) AND o.s NOT IN (SELECT s FROM broken)""",
}
