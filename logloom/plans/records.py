"""Queries of the general training-data problems (nested records, redelivery, drift, increments)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import drift, incremental, nested, redelivery


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls, results and responses of both transcript tables as flat rows that name their parents."""
    return nested.tool_items(_table(spark, sf, "session_lines"), _table(spark, sf, "chat_records"))


def p2_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The general form: every value of both transcript tables as a row with its parent."""
    lines = nested.node_table(_table(spark, sf, "session_lines"), "line_id", "message").select(F.lit("session_lines").alias("src"), "*")
    return lines.unionAll(nested.node_table(_table(spark, sf, "chat_records"), "record_id", "body").select(F.lit("chat_records").alias("src"), "*"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rows to drop so that one copy of each message stays."""
    lines = redelivery.line_deliveries(_table(spark, sf, "session_lines"))
    return redelivery.redelivered(lines.unionAll(redelivery.record_deliveries(_table(spark, sf, "chat_records"))))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of fields from one file of a stream to the next."""
    return drift.schema_changes(_table(spark, sf, "rollout_items"))


def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    """All rollout lines as one typed table with every field that any line holds; as text, what could not be cast or has no column."""
    lines, keep = _table(spark, sf, "rollout_items"), ["item_id", "stream_id", "file_id", "written_at", "line_no"]
    table = drift.consistent_table(lines, drift.consistent_columns(lines, keep), keep)
    return table.withColumns({c: table[c].cast("string") for c in ("failed_casts", "other_paths")})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions that each successful run takes because they are new or changed."""
    return incremental.taken_by_runs(_table(spark, sf, "session_index"), _table(spark, sf, "run_log"))


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p3_found, p4_found, p4_table, p5_found)}

_INSTANT = """CASE
    WHEN regexp_full_match({c}, '\\d{{13}}') THEN CAST({c} AS BIGINT) * 1000
    WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}') THEN epoch_us(TRY_CAST({c} AS TIMESTAMPTZ)) END"""

ORACLES = {
    "p3_found": """
WITH lines AS (
    SELECT 'session_lines' AS src, line_id AS row_id, session_id AS s, batch_no AS b, json_extract_string(message, '$.id') AS i,
           COALESCE(TRY_CAST(json_extract_string(message, '$.content[0].apiBlockIndex') AS BIGINT), TRY_CAST(json_extract_string(message, '$.content.apiBlockIndex') AS BIGINT), 0) AS k
    FROM session_lines WHERE message IS NOT NULL AND json_valid(message)
    UNION ALL
    SELECT 'chat_records', record_id, session_id, batch_no, json_extract_string(body, '$.id'), 0
    FROM chat_records WHERE body IS NOT NULL AND json_valid(body)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY src, s, i, k ORDER BY b DESC, row_id DESC) AS rn
    FROM lines WHERE s IS NOT NULL AND s <> '' AND i IS NOT NULL AND i <> ''
)
SELECT src, row_id FROM ranked WHERE rn > 1""",
    "p2_found": """
WITH lines AS (SELECT line_id, json_extract(message, '$.content') AS c FROM session_lines WHERE message IS NOT NULL AND json_valid(message)),
blocks AS (
    SELECT line_id, c AS b, 0 AS n FROM lines WHERE json_type(c) = 'OBJECT'
    UNION ALL
    SELECT line_id, UNNEST(json_extract(c, '$[*]')), UNNEST(range(0, json_array_length(c)::BIGINT)) FROM lines WHERE json_type(c) = 'ARRAY'
), records AS (SELECT record_id, body FROM chat_records WHERE body IS NOT NULL AND json_valid(body)),
holders AS (
    SELECT record_id, CAST(-1 AS BIGINT) AS m, CAST(body AS JSON) AS h FROM records
    UNION ALL
    SELECT record_id, UNNEST(range(0, json_array_length(body, '$.messages')::BIGINT)), UNNEST(json_extract(body, '$.messages[*]')) FROM records WHERE json_type(body, '$.messages') = 'ARRAY'
), arrays AS (
    SELECT record_id, m, 'call' AS kind, json_extract(h, '$.toolCalls') AS a FROM holders
    UNION ALL SELECT record_id, m, 'response', json_extract(h, '$.content') FROM holders
), parts AS (
    SELECT record_id, m, kind, a AS b, 0 AS n FROM arrays WHERE json_type(a) = 'OBJECT'
    UNION ALL
    SELECT record_id, m, kind, UNNEST(json_extract(a, '$[*]')), UNNEST(range(0, json_array_length(a)::BIGINT)) FROM arrays WHERE json_type(a) = 'ARRAY'
), flat AS (
    SELECT 'session_lines' AS src, line_id AS row_id, CAST(-1 AS BIGINT) AS msg_no, json_extract_string(b, '$.type') AS item_kind, n AS item_no,
           CASE WHEN json_extract_string(b, '$.type') = 'tool_use' THEN json_extract_string(b, '$.id') ELSE json_extract_string(b, '$.tool_use_id') END AS id,
           CASE WHEN json_extract_string(b, '$.type') = 'tool_use' THEN json_extract(b, '$.input') END AS args
    FROM blocks WHERE json_type(b) = 'OBJECT' AND json_extract_string(b, '$.type') IN ('tool_use', 'tool_result')
    UNION ALL
    SELECT 'chat_records', record_id, m, kind, n, CASE kind WHEN 'call' THEN json_extract_string(b, '$.id') ELSE json_extract_string(b, '$.functionResponse.id') END,
           CASE kind WHEN 'call' THEN json_extract(b, '$.args') END
    FROM parts WHERE json_type(b) = 'OBJECT' AND (kind = 'call' OR json_type(b, '$.functionResponse') = 'OBJECT')
), spelled AS (
    SELECT * EXCLUDE (args), CASE WHEN json_type(args) = 'OBJECT' THEN args WHEN json_type(args) = 'VARCHAR' AND json_valid(args ->> '$') THEN CAST(args ->> '$' AS JSON) END AS args FROM flat
)
SELECT src, row_id, msg_no, item_kind, CAST(item_no AS BIGINT) AS item_no, COALESCE(id, '') AS item_id,
       COALESCE(CASE WHEN json_type(args, '$.command') = 'ARRAY' THEN array_to_string(CAST(json_extract(args, '$.command') AS VARCHAR[]), ' ') ELSE json_extract_string(args, '$.command') END, '') AS command
FROM spelled""",
    "p5_found": f"""
WITH runs AS (SELECT DISTINCT run_id, cutoff_at FROM run_log WHERE status = 'ok'),
stamped AS (
    SELECT session_id, snap_id, arrived_at, COALESCE({_INSTANT.format(c='last_updated')}, {_INSTANT.format(c='last_message_ts')}) AS stamp FROM session_index WHERE session_id IS NOT NULL
), seen AS (
    SELECT run_id, cutoff_at, session_id, MAX(stamp) AS newest FROM runs JOIN stamped ON arrived_at <= cutoff_at WHERE stamp IS NOT NULL GROUP BY ALL
), steps AS (
    SELECT *, LAG(newest) OVER (PARTITION BY session_id ORDER BY cutoff_at) AS before FROM seen
)
SELECT t.run_id, t.session_id, MIN(s.snap_id) AS snap_id
FROM steps t JOIN stamped s ON s.session_id = t.session_id AND s.stamp = t.newest AND s.arrived_at <= t.cutoff_at
WHERE t.before IS NULL OR t.newest > t.before GROUP BY ALL""",
}
