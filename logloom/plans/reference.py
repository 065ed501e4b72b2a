"""The engine's operators lifted onto the driver's tables, each beside the SQL that must agree with it.

The ``events`` table is read as a log of sessions: a user is a session, event_id the position, event_type
the tool's name, props its JSON input, the day the turn. ``documents`` serves the text operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.kleene import all3, any3, group_any3, not3
from logloom.functions.patterns import java_regex, name_glob, path_glob
from logloom.operators import measure, sequence, validity
from logloom.plans import spec
from logloom.sources.sessions import best_copies, since_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The events table in the common event schema; the first letters of the type also serve as text."""
    e = _table(spark, sf, "events")
    return e.select(
        F.lit("log").alias("runtime"),
        F.col("user_id").cast("string").alias("session_id"),
        F.lit("").alias("path"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", "tool_result").when(F.col("event_type") == "signup", "user_prompt").when(F.col("event_type") == "view", "assistant_text").otherwise("tool_use").alias("kind"),
        F.dayofmonth("ts").alias("turn"),
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("name"),
        F.col("props").alias("input"),
        F.try_parse_json("props").alias("args"),
        F.concat(F.lit("a "), "event_type").alias("text"),
        (F.col("event_id") % 2 == 0).alias("final"),
        F.col("event_type").alias("model"),
        F.lit(None).cast("string").alias("tool_use_id"),
        F.lit(None).cast("string").alias("tool_name"),
        "value",
    )


_LOG = """log AS (SELECT 'log' AS runtime, CAST(user_id AS VARCHAR) AS session_id, event_id AS pos,
  CASE event_type WHEN 'error' THEN 'tool_result' WHEN 'signup' THEN 'user_prompt' WHEN 'view' THEN 'assistant_text' ELSE 'tool_use' END AS kind,
  CAST(day(ts) AS INTEGER) AS turn, CAST(event_id AS VARCHAR) AS id, event_type AS name, props AS input, 'a ' || event_type AS text, event_id % 2 = 0 AS final, value FROM events)"""


def _ids(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition).select("pos")


def _filtered(name: str, make: Callable[[], Column], sql: str) -> None:
    """A query of the log's events for which a matcher holds."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _ids(_log(spark, sf), make())

    run.__name__, run.__doc__ = name, f"Events for which the matcher of {name} is true."
    query(f"WITH {_LOG} SELECT pos FROM log WHERE {sql}")(run)


# ------------------------------------------------------------------------------------------ predicates

_filtered("tool_name", lambda: spec.matcher({"tool": ["click", "purchase"]}), "kind = 'tool_use' AND name IN ('click', 'purchase')")
_filtered("tool_glob", lambda: spec.matcher({"tool": {"glob": "p?rch*"}}), "kind = 'tool_use' AND name GLOB 'p?rch*'")
_filtered("kind_filter", lambda: spec.matcher({"kind": ["tool_result", "user_prompt"]}), "kind IN ('tool_result', 'user_prompt')")
_filtered("arg_exists", lambda: spec.matcher({"arg": {"field": "k", "exists": True}}), "kind = 'tool_use' AND json_extract(input, '$.k') IS NOT NULL")
_filtered("arg_equals", lambda: spec.matcher({"arg": {"field": "k", "equals": [7, "8", 9.0]}}), "kind = 'tool_use' AND CAST(json_extract(input, '$.k') AS INTEGER) IN (7, 9)")
_filtered("message_regex", lambda: spec.matcher({"message": {"regex": "(?i)^A V.EW$", "contains": "view"}}), "kind = 'assistant_text' AND regexp_matches(text, '(?i)^A V.EW$')")
_filtered("message_final", lambda: spec.matcher({"message": {"final": True}}), "kind = 'assistant_text' AND final")
_filtered("message_role", lambda: spec.matcher({"message": {"role": "user", "contains": ["sign", "x"]}}), "kind = 'user_prompt' AND contains(text, 'sign')")
_filtered("text_assistant", lambda: spec.matcher({"text": {"source": "assistant", "regex": "zzz", "contains": "iew"}}), "kind = 'assistant_text' AND contains(text, 'iew')")
_filtered("any_all_not", lambda: spec.matcher({"any": [{"tool": "click"}, {"all": [{"kind": "tool_use"}, {"not": [{"tool": "click"}, {"arg": {"field": "k", "equals": [1, 2, 3]}}]}]}]}), "kind = 'tool_use' AND (name = 'click' OR COALESCE(CAST(json_extract(input, '$.k') AS INTEGER) NOT IN (1, 2, 3), TRUE))")


def _written(name: str, matcher: dict, sql: str) -> None:
    """A query of the documents, each read as a call whose input holds its fields."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = _table(spark, sf, "documents")
        given = F.to_json(F.struct("text", "lang", "source"))
        return _ids(d.select(F.lit("tool_use").alias("kind"), F.lit("Write").alias("name"), F.try_parse_json(given).alias("args"), F.col("doc_id").alias("pos")), spec.matcher(matcher))

    run.__name__, run.__doc__ = name, f"Documents, read as calls, for which the matcher of {name} is true."
    query(f"SELECT doc_id AS pos FROM documents WHERE {sql}")(run)


_written("arg_missing", {"arg": {"field": ["lang", "text"], "exists": False}}, "lang IS NULL OR text IS NULL")
_written("arg_regex", {"arg": {"field": ["text", "source"], "regex": ["timeout=[0-9]+", "^rule_f"]}}, "COALESCE(regexp_matches(text, 'timeout=[0-9]+'), FALSE) OR COALESCE(starts_with(source, 'rule_f'), FALSE)")
_written("arg_contains", {"not": {"arg": {"field": "text", "contains": ["the", "7"]}}}, "NOT (COALESCE(contains(text, 'the'), FALSE) OR COALESCE(contains(text, '7'), FALSE))")


def _undecided(low: float, high: float) -> Column:
    """true below ``low``, undecided up to ``high``, else false."""
    return F.when(F.col("value") < low, True).when(F.col("value") < high, F.lit(None).cast("boolean")).otherwise(False)


_U = "CASE WHEN value < {} THEN TRUE WHEN value < {} THEN NULL ELSE FALSE END"


def _three(name: str, make: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _table(spark, sf, "events").select("event_id", make().alias("truth"))

    run.__name__, run.__doc__ = name, f"Three-valued logic over events: {name}."
    query(f"SELECT event_id, {sql} AS truth FROM events")(run)


_three("kleene_any", lambda: any3([_undecided(5, 20), F.col("event_type") == "click"]), f"({_U.format(5, 20)}) OR event_type = 'click'")
_three("kleene_all", lambda: all3([_undecided(20, 50), F.col("event_type") != "click"]), f"({_U.format(20, 50)}) AND event_type <> 'click'")
_three("kleene_not", lambda: not3(_undecided(10, 30)), f"NOT ({_U.format(10, 30)})")


@query(f"SELECT user_id, CASE WHEN bool_or(u) THEN TRUE WHEN count(*) > count(u) THEN NULL ELSE FALSE END AS truth FROM (SELECT user_id, {_U.format(0.2, 0.6)} AS u FROM events) GROUP BY user_id")
def kleene_group(spark, sf):
    """The three-valued OR as an aggregate."""
    return _table(spark, sf, "events").withColumn("u", _undecided(0.2, 0.6)).groupBy("user_id").agg(group_any3(F.col("u")).alias("truth"))


# ------------------------------------------------------------------------------------------- sequences

_ORDER = f"""WITH {_LOG}, s AS (SELECT *, CASE WHEN kind = 'tool_result' THEN 0 ELSE 1 END AS one FROM log),
c AS (SELECT *, sum(one) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cnt FROM s),
n AS (SELECT *, min(CASE WHEN name = 'purchase' THEN cnt - one END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt,
  min(CASE WHEN name = 'signup' AND value < 5 THEN cnt - one END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nu FROM c),
o AS (SELECT session_id, pos, CASE WHEN nt < cnt + 2 THEN TRUE WHEN nu < cnt + 2 THEN NULL ELSE FALSE END AS followed FROM n WHERE name = 'click') """


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    then = F.when(F.col("name") == "purchase", True).when((F.col("name") == "signup") & (F.col("value") < 5), F.lit(None).cast("boolean")).otherwise(False)
    return sequence.order_within(_log(spark, sf), F.col("name") == "click", then, 2).where("opened").select("session_id", "pos", "followed")


@query(_ORDER + "SELECT * FROM o")
def order_within(spark, sf):
    """Clicks, each with whether a purchase followed within two steps; a small signup leaves it open."""
    return _ordered(spark, sf)


@query(f"WITH {_LOG}, p AS (SELECT *, lag(name) OVER (PARTITION BY session_id ORDER BY pos) AS before FROM log WHERE name <> 'error' AND NOT starts_with(name, 'v')) SELECT session_id, pos FROM p WHERE before <> name")
def change_lag(spark, sf):
    """Where the type changes, errors and views stepped over."""
    keep = (F.col("name") != "error") & ~F.startswith("name", F.lit("v"))
    return sequence.change(_log(spark, sf), F.col("name"), keep).select("session_id", "pos")


@query(f"WITH {_LOG}, g AS (SELECT session_id, max_by(turn, pos) AS turn, bool_or(u) AS t, count(*) AS n, count(u) AS m FROM (SELECT *, {_U.format(0.3, 0.5)} AS u FROM log) GROUP BY session_id) SELECT session_id, turn FROM g WHERE NOT t AND n = m")
def absent_session(spark, sf):
    """Sessions in which decidedly nothing small happened, at their last turn."""
    return sequence.absent(_log(spark, sf), _undecided(0.3, 0.5)).where("absent").select("session_id", "turn")


@query(f"WITH {_LOG} SELECT session_id, turn, CASE WHEN bool_or(u) THEN TRUE WHEN count(*) > count(u) THEN NULL ELSE FALSE END AS followed FROM (SELECT *, {_U.format(2, 4)} AS u FROM log) GROUP BY session_id, turn")
def absent_turn(spark, sf):
    """Every turn, with whether something small happened in it."""
    return sequence.absent(_log(spark, sf), _undecided(2, 4), "turn").select("session_id", "turn", F.col("found").alias("followed"))


@query("SELECT event_id, CAST(count_if(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM events")
def running_turn(spark, sf):
    """The turn of each event: how many prompts came up to it."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _table(spark, sf, "events").select("event_id", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w).alias("turn"))


@query("WITH t AS (SELECT *, count_if(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, turn ORDER BY event_id DESC) AS n FROM t WHERE event_type = 'view') SELECT event_id FROM r WHERE n = 1")
def final_message(spark, sf):
    """The last message before the next prompt or the end."""
    from logloom.sources.files import final_flags

    e = _table(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") == "view", "assistant_text").when(F.col("event_type") == "signup", "user_prompt").otherwise("tool_use"))
    return final_flags(e, ("user_id",), "event_id").where("final").select("event_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM events")
def forward_fill(spark, sf):
    """The value of the latest signup, carried forward."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(w).alias("value"))


@query("SELECT p_partkey, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS slug FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY p_brand, slug ORDER BY p_partkey) AS n FROM (SELECT *, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug FROM part))")
def slug_ordinal(spark, sf):
    """Anchors made unique: the second 'testing' of a file is 'testing-2'."""
    p = _table(spark, sf, "part").withColumn("slug", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"))
    n = F.row_number().over(Window.partitionBy("p_brand", "slug").orderBy("p_partkey"))
    return p.withColumn("n", n).select("p_partkey", F.when(F.col("n") > 1, F.concat_ws("-", "slug", "n")).otherwise(F.col("slug")).alias("slug"))


# --------------------------------------------------------------------------------------------- reports

_DETECTORS = [
    {"id": "shop/click", "when": {"tool": "click"}},
    {"id": "shop/purchase", "when": {"tool": {"glob": "purch*"}}},
    {"id": "shop/never", "when": {"tool": "nothing"}},
    {"id": "chat/view", "event": "assistant_text", "when": {"message": {"contains": "view"}}},
    {"id": "chat/ask", "event": "session", "when": {"kind": "user_prompt"}},
    {"id": "shop/click-then-purchase", "event": "session", "when": {"order": {"first": {"tool": "click"}, "then": {"tool": "purchase"}, "within": 2}}},
]
_SQL_HITS = f"""WITH {_LOG},
s AS (SELECT *, CASE WHEN kind = 'tool_result' THEN 0 ELSE 1 END AS one FROM log),
c AS (SELECT *, sum(one) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cnt FROM s),
n AS (SELECT *, min(CASE WHEN name = 'purchase' THEN cnt - one END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM c),
o AS (SELECT session_id, turn, pos, id, COALESCE(nt < cnt + 2, FALSE) AS followed FROM n WHERE name = 'click'),
hits AS (
  SELECT session_id, 'shop/click' AS detector, turn, id AS tool_use_id, pos FROM log WHERE name = 'click'
  UNION ALL SELECT session_id, 'shop/purchase', turn, id, pos FROM log WHERE name = 'purchase'
  UNION ALL SELECT session_id, 'chat/view', turn, NULL, pos FROM log WHERE name = 'view'
  UNION ALL SELECT session_id, 'chat/ask', turn, NULL, pos FROM log WHERE name = 'signup'
  UNION ALL SELECT session_id, 'shop/click-then-purchase', turn, id, pos FROM o WHERE followed),
known AS (SELECT UNNEST(['shop/click', 'shop/purchase', 'shop/never', 'chat/view', 'chat/ask', 'shop/click-then-purchase']) AS detector),
sessions AS (SELECT DISTINCT session_id FROM log)
"""


def _compiled() -> list[spec.Compiled]:
    return [spec.compile_detector(d) for d in _DETECTORS]


def _without_parse(log: DataFrame) -> DataFrame:
    from logloom.functions.shellparse import PARSE

    return log.withColumn("parse", F.lit(None).cast(PARSE))  # the log has no shell commands


def _sessions(log: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """A session per user; the customer of that number gives the repository."""
    nations = _table(spark, sf, "customer").join(_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("session_id"), F.col("n_name").alias("repo"))
    users = log.groupBy("runtime", "session_id").agg(F.count("*").alias("n_events")).withColumn("started", F.lit("")).withColumn("ended", F.lit(""))
    return users.join(nations, "session_id", "left")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    log = _without_parse(_log(spark, sf))
    return measure.measure(_sessions(log, spark, sf), log, _compiled(), {"mode": "fast", "team": "red"})


@query(_SQL_HITS + "SELECT session_id, detector, turn, tool_use_id, pos FROM hits")
def detector_hits(spark, sf):
    """Every hit of a small library of detectors, per-event ones found in one pass."""
    return measure.find_hits(_without_parse(_log(spark, sf)), _compiled()).drop("runtime")


@query(_SQL_HITS + "SELECT session_id, detector, count(*) AS n FROM hits GROUP BY ALL")
def hits_per_session(spark, sf):
    """Hits by session and detector, zero counts left out."""
    return measure.find_hits(_without_parse(_log(spark, sf)), _compiled()).groupBy("session_id", "detector").agg(F.count("*").alias("n"))


@query(_SQL_HITS + """, by_rule AS (SELECT detector, count(*) AS hits, count(DISTINCT session_id) AS sessions FROM hits GROUP BY detector), total AS (SELECT count(*) AS n FROM sessions)
SELECT detector, COALESCE(hits, 0) AS hits, COALESCE(sessions, 0) AS sessions, n AS of, COALESCE(sessions, 0) / n AS share,
  CASE WHEN n < 20 THEN '' WHEN COALESCE(sessions, 0) / n > 0.30 THEN 'frequent' WHEN COALESCE(hits, 0) = 0 THEN 'unobserved' ELSE '' END AS note
FROM known LEFT JOIN by_rule USING (detector), total""")
def report_by_rule(spark, sf):
    """The flagship: hits, sessions and share by detector, with notes."""
    return measure.report_by_rule(_rows(spark, sf), [d["id"] for d in _DETECTORS]).select("detector", "hits", "sessions", "of", "share", "note")


@query(_SQL_HITS + """SELECT count(*) AS opportunities, CAST(count_if(followed) AS BIGINT) AS followed, count_if(followed) / count(*) AS rate,
CASE WHEN count_if(followed) = 0 THEN 0 WHEN count_if(followed) = count(*) THEN 100 ELSE greatest(1, least(99, CAST(round(100 * count_if(followed) / count(*)) AS INTEGER))) END AS shown FROM o""")
def compliance_rate(spark, sf):
    """Opportunities of the order detector, and how many were taken."""
    r = measure.report_by_rule(_rows(spark, sf), []).where("detector = 'shop/click-then-purchase'")
    return r.select("opportunities", "followed", "rate", measure.rate_display(F.col("rate")).alias("shown"))


@query(_SQL_HITS + """, repo AS (SELECT session_id, COALESCE(n_name, '(no repo)') AS key FROM sessions LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = session_id LEFT JOIN nation ON c_nationkey = n_nationkey),
per AS (SELECT key, detector, count(*) AS n FROM hits JOIN repo USING (session_id) GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, detector) AS r FROM per)
SELECT key, (SELECT count(*) FROM repo q WHERE q.key = p.key) AS sessions, CAST(sum(n) AS BIGINT) AS hits, string_agg(CASE WHEN r <= 3 THEN detector END, ',' ORDER BY r) AS top FROM ranked p GROUP BY key""")
def report_by_repo(spark, sf):
    """Sessions, hits and the three most frequent detectors by repository."""
    return measure.report_by_group(_rows(spark, sf), "repo").withColumn("top", F.array_join("top", ","))


@query(_SQL_HITS + """, per AS (SELECT key, detector, count(*) AS n FROM hits, (SELECT UNNEST(['mode=fast', 'team=red']) AS key) GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, detector) AS r FROM per)
SELECT key, (SELECT count(*) FROM sessions) AS sessions, CAST(sum(n) AS BIGINT) AS hits, string_agg(CASE WHEN r <= 3 THEN detector END, ',' ORDER BY r) AS top FROM ranked GROUP BY key""")
def report_by_stance(spark, sf):
    """The same by stance, to each of which a session counts."""
    return measure.report_by_group(_rows(spark, sf), "stance").withColumn("top", F.array_join("top", ","))


@query("WITH c AS (SELECT event_type AS key, CAST(user_id AS VARCHAR) AS detector, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, detector) AS r FROM c) SELECT key, string_agg(detector, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY key")
def top3_per_group(spark, sf):
    """The three most frequent users of each event type; ties by name."""
    counts = _table(spark, sf, "events").groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("detector")).agg(F.count("*").alias("n"))
    return measure.top_per_group(counts).withColumn("top", F.array_join("top", ","))


@query("WITH m AS (SELECT event_type AS detector, CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS folded FROM events) SELECT folded AS detector, count(*) AS hits FROM m GROUP BY ALL")
def rename_fold(spark, sf):
    """Counts under present names after a retired one was folded in."""
    return measure.fold_names(_table(spark, sf, "events").withColumn("detector", F.col("event_type")), {"view": "click"}).groupBy("detector").agg(F.count("*").alias("hits"))


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, count(DISTINCT event_id % 97) AS failed FROM events WHERE event_type = 'error' GROUP BY ALL")
def error_counts(spark, sf):
    """Distinct failures per session."""
    return _table(spark, sf, "events").where("event_type = 'error'").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.count_distinct(F.col("event_id") % 97).alias("failed"))


@query("SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown schema' WHEN o_orderstatus = 'P' THEN 'no rules' ELSE 'ok' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def row_status(spark, sf):
    """Stored rows by whether they can be counted: exactly one status each."""
    o = _table(spark, sf, "orders")
    rows = o.select(F.when(F.col("o_orderpriority").startswith("1"), 9).otherwise(2).alias("schema_version"), F.when(F.col("o_orderstatus") != "P", F.create_map().cast("map<string,long>")).alias("rules"))
    return measure.row_status(rows).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT t.session_id, t.detector FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, d.event_type AS detector FROM events, (SELECT DISTINCT event_type FROM events) d) t ANTI JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, event_type AS detector FROM events WHERE value > 60) e ON t.session_id = e.session_id AND t.detector = e.detector")
def denominator_anti(spark, sf):
    """Sessions x detectors without the failed ones: what a share is taken of."""
    e = _table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("detector"), "value")
    names = e.select("detector").distinct().agg(F.collect_set("detector").alias("names"))  # a handful of detectors, one row
    measured = e.select("session_id").distinct().join(F.broadcast(names)).select("session_id", F.explode("names").alias("detector"))
    return measured.join(e.where("value > 60").select("session_id", "detector").distinct(), ["session_id", "detector"], "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def never_ran_anti(spark, sf):
    """Calls without those whose result says that they never ran."""
    return _table(spark, sf, "orders").join(_table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events QUALIFY event_type = 'error'")
def tool_result_asof(spark, sf):
    """Each result with the latest earlier call."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = _table(spark, sf, "events").withColumn("click_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'error'").select("event_id", "click_id")


@query(_SQL_HITS + "SELECT h.session_id, h.detector, h.turn || ':' || COALESCE(h.tool_use_id, '-') AS key, l.input FROM hits h LEFT JOIN log l ON l.kind = 'tool_use' AND l.session_id = h.session_id AND l.turn = h.turn AND l.id = h.tool_use_id")
def explain_join(spark, sf):
    """Hits with the call that they are on."""
    from logloom.operators.explain import with_calls

    log = _without_parse(_log(spark, sf))
    return with_calls(measure.find_hits(log, _compiled()), log).select("session_id", "detector", "key", "input")


# -------------------------------------------------------------------------------------------- validity

_VALID = """WITH docs AS (SELECT doc_id, lower(COALESCE(lang, '')) AS detector, source, n_chars FROM documents), named AS (SELECT DISTINCT detector FROM docs WHERE n_chars > 700 OR source = 'rule_file'),
fire AS (SELECT DISTINCT doc_id, detector FROM docs WHERE n_chars > 700), near AS (SELECT DISTINCT doc_id, detector FROM docs WHERE NOT COALESCE(n_chars > 700, FALSE) AND source = 'rule_file'),
found AS (SELECT DISTINCT doc_id, detector FROM docs WHERE source IN ('assistant_text', 'rule_file')),
counts AS (SELECT detector, (SELECT count(*) FROM fire f WHERE f.detector = n.detector) AS positives, (SELECT count(*) FROM near f WHERE f.detector = n.detector) AS negatives,
 (SELECT count(*) FROM fire f SEMI JOIN found g ON f.doc_id = g.doc_id AND f.detector = g.detector WHERE f.detector = n.detector) AS tp,
 (SELECT count(*) FROM found f ANTI JOIN fire g ON f.doc_id = g.doc_id AND f.detector = g.detector WHERE f.detector = n.detector) AS fp,
 (SELECT count(*) FROM fire f ANTI JOIN found g ON f.doc_id = g.doc_id AND f.detector = g.detector WHERE f.detector = n.detector) AS fn FROM named n),
scored AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM counts) """


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").select(F.col("doc_id").alias("session"), F.lit("0:-").alias("key"), F.lower(F.coalesce("lang", F.lit(""))).alias("detector"), "source", "n_chars")
    polarity = F.when(F.col("n_chars") > 700, "fire").when(F.col("source") == "rule_file", "near")
    return validity.validity_counts(d.where("source in ('assistant_text', 'rule_file')"), d.withColumn("polarity", polarity).where("polarity is not null"))


@query(_VALID + "SELECT * FROM counts")
def validity_counts(spark, sf):
    """True and false positives and misses by detector: a full outer join of hits and labels."""
    return _counts(spark, sf)


@query(_VALID + "SELECT detector, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM scored")
def precision_recall_f1(spark, sf):
    """Precision, recall and their mean by detector."""
    return validity.scores(_counts(spark, sf)).select("detector", "precision", "recall", "f1")


@query(_VALID + "SELECT detector FROM scored WHERE round(p, 4) < 0.6 OR round(r, 4) < 0.6")
def below_floor(spark, sf):
    """Detectors below a floor."""
    return validity.below_floor(validity.scores(_counts(spark, sf)), 0.6)


@query(_VALID + "SELECT COALESCE(detector, '(all)') AS detector, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts GROUP BY ROLLUP (detector)")
def rollup_total(spark, sf):
    """The counts with a line over all."""
    return validity.total(_counts(spark, sf)).select("detector", "tp", "fp", "fn")


_FIRE = "SELECT doc_id FROM documents WHERE n_chars > 700"
_FOUND = "SELECT doc_id FROM documents WHERE source = 'assistant_text'"


def _sets(spark, sf):
    d = _table(spark, sf, "documents")
    return d.where("n_chars > 700").select("doc_id"), d.where("source = 'assistant_text'").select("doc_id")


@query(f"({_FIRE}) INTERSECT ({_FOUND})")
def tp_intersect(spark, sf):
    """Wanted and found."""
    fire, found = _sets(spark, sf)
    return fire.intersect(found)


@query(f"({_FOUND}) EXCEPT ({_FIRE})")
def fp_except(spark, sf):
    """Found, not wanted."""
    fire, found = _sets(spark, sf)
    return found.subtract(fire)


@query(f"({_FIRE}) EXCEPT ({_FOUND})")
def fn_except(spark, sf):
    """Wanted, not found."""
    fire, found = _sets(spark, sf)
    return fire.subtract(found)


@query(f"({_FIRE}) UNION ({_FOUND})")
def union_ids(spark, sf):
    """Either."""
    fire, found = _sets(spark, sf)
    return fire.union(found).distinct()


# ------------------------------------------------------------------------------ sources and scalar text


@query("SELECT session_id, path, n_events FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN session_id = '' THEN '?' || path ELSE session_id END ORDER BY n_events DESC, path) AS r FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS session_id, CAST(o_orderkey AS VARCHAR) AS path, CAST(floor(o_totalprice / 100000) AS BIGINT) AS n_events FROM orders)) WHERE r = 1")
def dedup_most_events(spark, sf):
    """Of the copies of a session the one with most events, then the first path; without an id each its own."""
    o = _table(spark, sf, "orders").select(F.lit("a").alias("runtime"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_custkey").cast("string")).alias("session_id"), F.col("o_orderkey").cast("string").alias("path"), F.floor(F.col("o_totalprice") / 100000).alias("n_events"))
    return best_copies(o)[0].select("session_id", "path", "n_events")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1")
def distinct_content(spark, sf):
    """One of each content, by hash; the shortest, then the first name."""
    d = _table(spark, sf, "documents").where("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return d.agg(F.min(F.struct("n_chars", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("doc_id"))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1998-01-01'")
def since_filter_days(spark, sf):
    """What ended on a day or later, compared as text."""
    return _table(spark, sf, "orders").where(since_filter(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "1998-01-01")).select("o_orderkey")


@query("SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, min_by(event_type, event_id) FILTER (event_type <> 'error') AS first_type, count(*) AS n FROM events GROUP BY user_id")
def session_bounds(spark, sf):
    """First and last event and the first type that is no error, per session."""
    kept = F.when(F.col("event_type") != "error", F.col("event_id"))
    return _table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.min_by("event_type", kept).alias("first_type"), F.count("*").alias("n"))


@query("SELECT user_id, CAST(count_if(event_type = 'click') AS BIGINT) AS web_searches, CAST(count_if(event_type = 'view') AS BIGINT) AS agents, CAST(count_if(event_type = 'signup') AS BIGINT) AS questions FROM events GROUP BY user_id")
def tool_counts(spark, sf):
    """Uses of three tools per session."""
    named = F.when(F.col("event_type") == "click", "WebSearch").when(F.col("event_type") == "view", "Agent").when(F.col("event_type") == "signup", "AskUserQuestion").otherwise("")
    e = _table(spark, sf, "events").select(F.lit("").alias("runtime"), F.col("user_id").alias("session_id"), F.lit("tool_use").alias("kind"), named.alias("name"))
    return measure.tool_counts(e).select(F.col("session_id").alias("user_id"), "web_searches", "agents", "questions")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def json_path(spark, sf):
    """Dotted paths into JSON; NULL where the path ends early."""
    v = F.try_parse_json("props")
    return _table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.a.b", "string").alias("missing"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name || '/' || p_type || '.py', '(^|^.*/)[^/]*(ECO|STA)[^/]*\\.py$')")
def arg_path_glob(spark, sf):
    """Path globs: a star stops at a slash."""
    path = F.concat("p_name", F.lit("/"), "p_type", F.lit(".py"))
    return _table(spark, sf, "part").where(path.rlike(path_glob("*ECO*.py")) | path.rlike(path_glob("*STA*.py"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name GLOB '*r[ei][dn]*'")
def name_glob_match(spark, sf):
    """Name globs with classes."""
    return _table(spark, sf, "part").where(F.col("p_name").rlike(name_glob("*r[ei][dn]*"))).select("p_partkey")


_RULES = (("colour/red", r"^red\b"), ("size/small", "^small "), ("thing/ring", ".*ring$"))


@query("SELECT p_partkey, r.detector FROM part, (VALUES " + ", ".join(f"('{d}', '{p}')" for d, p in _RULES) + ") r(detector, pattern) WHERE regexp_matches(p_name, r.pattern)")
def theta_regex_join(spark, sf):
    """Sentences x patterns: the few patterns are columns of one pass, not rows of a join."""
    matched = F.array_compact(F.array(*[F.when(F.col("p_name").rlike(java_regex(p)), F.lit(d)) for d, p in _RULES]))
    return _table(spark, sf, "part").select("p_partkey", F.explode(matched).alias("detector"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'timeout=[0-9]+\\.[0-9]+')")
def secret_assign_regex(spark, sf):
    """Texts with an assignment of a given shape."""
    return _table(spark, sf, "documents").where(F.col("text").rlike(java_regex(r"timeout=[0-9]+\.[0-9]+"))).select("doc_id")


_TEXT_FUNCTIONS: dict[str, tuple[Callable[[], Column], str]] = {
    "normalise": (lambda: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " "), r"^cd (?:[^\s\\]|\\.)+ ?&& ?", "")), r"trim(regexp_replace(regexp_replace(COALESCE(text, ''), '[ \t\n\r]+', ' ', 'g'), '^cd (?:[^\s\\]|\\.)+ ?&& ?', ''))"),
    "slug": (lambda: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9 -]", ""), " +", "-"), "regexp_replace(regexp_replace(lower(COALESCE(text, '')), '[^a-z0-9 -]', '', 'g'), ' +', '-', 'g')"),
    "section_sha256": (lambda: F.sha2(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), r"[ \t]+\n", "\n").cast("binary"), 256), r"sha256(regexp_replace(regexp_replace(COALESCE(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'))"),
    "cap_text": (lambda: F.when(F.length("text") > 400, F.concat(F.substring("text", 1, 400), F.lit(" ... "), (F.length("text") - 400).cast("string"), F.lit(" more"))).otherwise(F.col("text")), "CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || ' ... ' || (length(text) - 400) || ' more' ELSE text END"),
    "redact_token": (lambda: F.regexp_replace(F.coalesce("text", F.lit("")), r"\b[0-9a-f]{32}\b", "[redacted]"), r"regexp_replace(COALESCE(text, ''), '\b[0-9a-f]{32}\b', '[redacted]', 'g')"),
}


def _text_query(name: str, make: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _table(spark, sf, "documents").select("doc_id", make().alias("result"))

    run.__name__, run.__doc__ = name, f"The text function {name} over all documents."
    query(f"SELECT doc_id, {sql} AS result FROM documents")(run)


for _name, (_make, _sql) in _TEXT_FUNCTIONS.items():
    _text_query(_name, _make, _sql)


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^a-z])(unless|except|if|when)([^a-z]|$)') AS conditional, regexp_extract(text, '(?i)(?:^|[^a-z])(always|never|must|do not)(?:[^a-z]|$)', 1) AS modal FROM documents WHERE text IS NOT NULL")
def marker_words(spark, sf):
    """Words that make a rule conditional or absolute."""
    d = _table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.col("text").rlike(r"(?i)(^|[^a-z])(unless|except|if|when)([^a-z]|$)").alias("conditional"), F.regexp_extract("text", r"(?i)(?:^|[^a-z])(always|never|must|do not)(?:[^a-z]|$)", 1).alias("modal"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) || ':' || CASE WHEN l_returnflag = 'N' THEN '-' ELSE l_returnflag END AS key FROM lineitem")
def hit_key(spark, sf):
    """The key of a point: turn and call, or a dash."""
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", validity.hit_key(F.col("l_linenumber"), flag).alias("key"))


@query("SELECT source, count(*) AS n, CAST(count_if(lang IS NOT NULL) AS BIGINT) AS measured, count_if(lang IS NOT NULL) / count(*) AS share FROM documents GROUP BY source")
def coverage_share(spark, sf):
    """Counts and the share measured, by state."""
    known = F.col("lang").isNotNull()
    return _table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(known).alias("measured"), (F.count_if(known) / F.count("*")).alias("share"))


@query(_SQL_HITS + "SELECT session_id, detector, turn, pos, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, CASE WHEN tool_use_id IS NULL THEN -1 ELSE pos END, detector, pos) AS BIGINT) AS place FROM hits")
def explain_order(spark, sf):
    """Hits of a session in the order in which they are explained."""
    from logloom.operators.explain import explain_order as order

    hits = measure.find_hits(_without_parse(_log(spark, sf)), _compiled())
    return hits.select("session_id", "detector", "turn", "pos", F.row_number().over(Window.partitionBy("session_id").orderBy(*order())).cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 WHEN l_discount = 1 THEN 100 ELSE greatest(1, least(99, CAST(round(100 * l_discount) AS INTEGER))) END AS shown FROM lineitem")
def rate_display(spark, sf):
    """Rates as whole percent: only none shows as 0."""
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", measure.rate_display(F.col("l_discount")).alias("shown"))


@query(_SQL_HITS + """, by_rule AS (SELECT detector, count(*) AS hits FROM hits GROUP BY detector) SELECT detector, COALESCE(hits, 0) AS hits FROM known LEFT JOIN by_rule USING (detector) ORDER BY hits DESC, detector LIMIT 3""")
def sorted_report(spark, sf):
    """The three detectors with most hits: a top-k report."""
    return measure.report_by_rule(_rows(spark, sf), [d["id"] for d in _DETECTORS]).orderBy(F.desc("hits"), "detector").limit(3).select("detector", "hits")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def limit_k(spark, sf):
    """The five largest sessions: a top-k report."""
    return _table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5)


# ------------------------------------------------------- operators that SQL cannot express: rows only


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    """The shell commands of the transcripts as events."""
    from logloom.operators.nested import tool_items

    items = tool_items(_table(spark, sf, "session_lines")).where("item_kind = 'tool_use' and command <> ''")
    return items.select(
        F.lit("a").alias("runtime"), F.col("row_id").cast("string").alias("session_id"), F.col("item_no").alias("pos"), F.lit("tool_use").alias("kind"), F.lit(1).alias("turn"), F.col("item_id").alias("id"),
        F.lit("Bash").alias("name"), F.to_json(F.struct("command")).alias("input"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("final"), F.lit("").alias("model"),
    )


@query()
def shell_segments(spark, sf):
    """The segments of every shell command of the transcripts."""
    p = measure.parsed_events(_commands(spark, sf))
    return p.select("session_id", "pos", F.posexplode("parse.segments").alias("segment", "s")).select("session_id", "pos", "segment", F.array_join("s.tokens", " ").alias("tokens"), "s.program", "s.n_operands", "s.redirected", "s.alone", "s.unsure")


def _transcript(spark: SparkSession, sf: str) -> DataFrame:
    """The transcripts of runtime A as events. Side chains are sessions of their own, as in that runtime's folders; so are lines without a session."""
    from logloom.sources.transcripts import read_a_table

    side = F.coalesce("is_sidechain", F.lit(False))
    table = _table(spark, sf, "session_lines").withColumns(
        {
            "session_id": F.coalesce("session_id", F.concat(F.lit("line-"), F.col("line_id").cast("string"))),
            "agent_id": F.when(side, F.coalesce(F.nullif("agent_id", F.lit("")), F.lit("side"))).otherwise(F.col("agent_id")),
        }
    )
    return read_a_table(table, F.concat_ws("/", "session_id", F.when(side, F.col("agent_id"))))[0]


def _readable_inputs(events: DataFrame) -> DataFrame:
    """Inputs spelled as JSON text are read as what they spell; commands given as lists are joined by blanks."""
    e = events.withColumn("__i", F.try_parse_json("input"))
    e = e.withColumn("__i", F.expr("case when schema_of_variant(__i) = 'STRING' then coalesce(try_parse_json(try_variant_get(__i, '$', 'string')), __i) else __i end"))
    words = "try_variant_get(__i, '$.command', 'array<string>')"
    fields = "try_variant_get(__i, '$', 'map<string,variant>')"
    joined = f"to_json(map_concat(map_filter({fields}, (k, v) -> k <> 'command'), map('command', cast(array_join({words}, ' ') as variant))))"
    return e.withColumn("input", F.expr(f"case when {words} is not null then {joined} else to_json(__i) end")).drop("__i")


@query()
def library_hits(spark, sf):
    """Hits of all shipped detectors over the events of the transcripts."""
    from logloom.detectors import LIBRARY
    from logloom.storage import materialize

    events = materialize(measure.parsed_events(_readable_inputs(_transcript(spark, sf))), "events-parsed")  # read by each detector over sequences
    return measure.find_hits(events, [spec.compile_detector(d) for d in LIBRARY])


@query()
def redacted_documents(spark, sf):
    """All texts with what looks like a secret taken out."""
    from logloom.functions.redact import with_redacted

    return with_redacted(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "redacted", F.col("n_secrets"))


@query()
def markdown_units(spark, sf):
    """Sections and paragraphs of all rule files."""
    from logloom.operators.binder import rule_sections

    return rule_sections(_table(spark, sf, "documents").where("source = 'rule_file'").select(F.col("doc_id").cast("string").alias("path"), "text"))


@query()
def heading_slugs(spark, sf):
    """The slug of every heading of all documents, uncut and with letters of every script."""
    from logloom.operators.binder import heading_slugs as slugs

    return slugs(_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


@query()
def bound_rules(spark, sf):
    """Rules of all rule files with their state: bound to one detector, or why not."""
    from logloom.detectors import SHAPES
    from logloom.operators.binder import bind_rules

    return bind_rules(_table(spark, sf, "documents").where("source = 'rule_file'").select(F.col("doc_id").cast("string").alias("path"), "text"), SHAPES)


@query()
def session_events(spark, sf):
    """The transcripts of runtime A as events in the common schema."""
    return _transcript(spark, sf)
