"""Events -> hits and opportunities -> one row per session -> reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.shellparse import with_parse
from logloom.plans.spec import Compiled, with_args
from logloom.schema import SCHEMA_READ, SCHEMA_WRITTEN

MIN_SESSIONS, FREQUENT_SHARE, MIN_OPPORTUNITIES = 20, 0.30, 20
_HITS = "runtime string, session_id string, detector string, turn int, tool_use_id string, pos long"


def parsed_events(events: DataFrame) -> DataFrame:
    """Events with the parse of their shell command; each command is parsed once, whatever the number of detectors."""
    bash = (F.col("kind") == "tool_use") & (F.col("name") == "Bash")
    args = F.try_parse_json("input")
    command = F.when(F.schema_of_variant(F.try_variant_get(args, "$.command", "variant")) == "STRING", F.try_variant_get(args, "$.command", "string")).otherwise("")
    return with_args(with_parse(events.withColumn("__bash", F.when(bash, F.coalesce(command, F.lit("")))), "__bash").drop("__bash"))


def find_hits(events: DataFrame, detectors: list[Compiled], stances: dict[str, str] | None = None) -> DataFrame:
    """(runtime, session_id, detector, turn, tool_use_id, pos) of every hit of every enabled detector.

    All detectors that look at one event at a time are evaluated in one pass over the events: their
    conditions become one array of names. Only detectors over sequences add a pass of their own.
    """
    events = with_args(events)
    on = [d for d in detectors if d.enabled(stances)]
    single = [d for d in on if d.predicate is not None]
    parts = []
    if single:
        names = F.array_compact(F.array(*[F.when(d.predicate, F.lit(d.id)) for d in single]))
        tool = F.when(F.col("kind") == "tool_use", F.col("id"))
        parts.append(events.select("runtime", "session_id", F.explode(names).alias("detector"), "turn", tool.alias("tool_use_id"), "pos"))
    parts += [d.hits(events).withColumn("detector", F.lit(d.id)) for d in on if d.predicate is None]
    if not parts:
        return events.sparkSession.createDataFrame([], _HITS)
    return reduce(lambda a, b: a.unionByName(b), [p.select("runtime", "session_id", "detector", "turn", "tool_use_id", "pos") for p in parts])


def find_opportunities(events: DataFrame, detectors: list[Compiled], stances: dict[str, str] | None = None) -> DataFrame | None:
    """(runtime, session_id, detector, turn, tool_use_id, followed) of the detectors that have opportunities."""
    events = with_args(events)
    parts = [d.opportunities(events).withColumn("detector", F.lit(d.id)) for d in detectors if d.enabled(stances) and d.opportunities is not None]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def tally(opportunities: DataFrame) -> DataFrame:
    """Compliance counts per session and detector; ``malformed`` where one (turn, id) point occurs twice.

    Points without an id may repeat; undecided ones are counted apart from followed and not followed.
    """
    keyed = F.when(F.coalesce("tool_use_id", F.lit("")) != "", F.struct("turn", "tool_use_id"))
    return opportunities.groupBy("runtime", "session_id", "detector").agg(
        F.count("*").alias("opportunities"),
        F.count_if(F.coalesce("followed", F.lit(False))).alias("followed"),
        F.count_if(F.col("followed").isNull()).alias("undecided"),
        (F.count(keyed) > F.count_distinct(keyed)).alias("malformed"),
    )


def measure(sessions: DataFrame, events: DataFrame, detectors: list[Compiled], stances: dict[str, str] | None = None) -> DataFrame:
    """One row per session in the schema ROWS: hits by detector (zero counts are left out), compliance, errors."""
    hits = find_hits(events, detectors, stances).groupBy("runtime", "session_id", "detector").agg(F.count("*").alias("n"))
    keys = ["runtime", "session_id"]
    rules = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("detector", "n"))).alias("rules"))
    rows = sessions.join(rules, keys, "left")
    found = find_opportunities(events, detectors, stances)
    entry = F.struct("opportunities", "followed", "undecided")
    if found is not None:
        counted = tally(found)
        rows = rows.join(
            counted.groupBy(*keys).agg(
                F.map_from_entries(F.collect_list(F.when(~F.col("malformed"), F.struct("detector", entry)))).alias("compliance"),
                F.collect_list(F.when(F.col("malformed"), F.struct("detector", F.lit("an opportunity is named twice").alias("error")))).alias("rules_errors"),
            ),
            keys,
            "left",
        )
    else:
        rows = rows.withColumn("compliance", F.lit(None).cast("map<string,struct<opportunities:long,followed:long,undecided:long>>"))
        rows = rows.withColumn("rules_errors", F.lit(None).cast("array<struct<detector:string,error:string>>"))
    given = F.create_map(*[F.lit(x) for kv in (stances or {}).items() for x in kv]) if stances else F.create_map()
    return rows.select(
        F.lit(SCHEMA_WRITTEN).alias("schema_version"), "session_id", "repo", "runtime", "started", "ended", given.cast("map<string,string>").alias("stances"),
        F.coalesce("rules", F.create_map().cast("map<string,long>")).alias("rules"), "compliance", F.coalesce("rules_errors", F.array().cast("array<struct<detector:string,error:string>>")).alias("rules_errors"),
    )


def row_status(rows: DataFrame) -> DataFrame:
    """Adds ``status``: ok, unknown schema, no rules; exactly one per row."""
    status = F.when(~F.coalesce(F.coalesce("schema_version", F.lit(1)).isin(*SCHEMA_READ), F.lit(False)), "unknown schema").when(F.col("rules").isNull(), "no rules").otherwise("ok")
    return rows.withColumn("status", status)


def fold_names(df: DataFrame, fold: dict[str, str], column: str = "detector") -> DataFrame:
    """Retired detector names replaced by their present ones."""
    return df.withColumn(column, _present(F.col(column), fold))


def report_by_rule(rows: DataFrame, known: list[str], fold: dict[str, str] | None = None, min_sessions: int = MIN_SESSIONS, frequent_share: float = FREQUENT_SHARE, min_opportunities: int = MIN_OPPORTUNITIES) -> DataFrame:
    """(detector, hits, sessions, of, share, note, opportunities, followed, undecided, rate): one row per detector.

    ``of`` counts the measured sessions in which this detector did not fail; ``share`` is 0 if that is none.
    ``note``: frequent above ``frequent_share``, unobserved without a hit, both only from ``min_sessions`` on.
    ``rate`` is NULL below ``min_opportunities``. Detectors found only in rows are listed too.
    """
    spark, fold = rows.sparkSession, fold or {}
    ok = row_status(rows).where("status = 'ok'").select("rules", "compliance", F.transform("rules_errors", lambda e: _present(e["detector"], fold)).alias("failed"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")

    def entry(name, hits=zero, sessions=zero, by_hits=False, lost=zero, opportunities=none, followed=none, undecided=none, total=zero):
        fields = {"detector": name, "hits": hits, "sessions": sessions, "by_hits": F.lit(by_hits), "lost": lost, "opportunities": opportunities, "followed": followed, "undecided": undecided, "total": total}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    # Each row tells all it has to say in one array, so that the rows are read once and grouped once. A session counts
    # once for a detector, though several of its names may have been folded into one.
    failed = lambda name: F.coalesce(F.array_contains("failed", name), F.lit(False))
    counted = F.filter(F.transform(F.map_entries("rules"), lambda e: F.struct(_present(e["key"], fold).alias("name"), e["value"].alias("n"))), lambda e: ~failed(e["name"]))
    kept = F.filter(F.transform(F.map_entries("compliance"), lambda e: F.struct(_present(e["key"], fold).alias("name"), e["value"].alias("c"))), lambda e: ~failed(e["name"]))
    ok = ok.select(F.coalesce("failed", F.array().cast("array<string>")).alias("failed"), "rules", "compliance").select("failed", counted.alias("counted"), kept.alias("kept"))
    positive = F.transform(F.filter("counted", lambda e: e["n"] > 0), lambda e: e["name"])
    ok = ok.select("failed", "counted", "kept", positive.alias("positive"))
    hits = F.transform("counted", lambda e: entry(e["name"], hits=e["n"], by_hits=True))
    present = F.transform(F.array_distinct("positive"), lambda n: entry(n, sessions=F.lit(1).cast("long"), by_hits=True))
    lost = F.transform(F.array_distinct("failed"), lambda n: entry(n, lost=F.lit(1).cast("long")))
    share = F.transform(F.coalesce("kept", F.array().cast(_KEPT)), lambda e: entry(e["name"], opportunities=e["c"]["opportunities"], followed=e["c"]["followed"], undecided=e["c"]["undecided"]))
    one = F.array(entry(F.lit(None).cast("string"), total=F.lit(1).cast("long")))
    told = ok.select(F.explode(F.concat(hits, present, lost, share, one)).alias("t")).select("t.*")
    listed = spark.createDataFrame([(k,) for k in known], "detector string").select(entry(F.col("detector"), by_hits=True).alias("t")).select("t.*")
    sums = [F.sum(c).alias(c) for c in ("hits", "sessions", "lost", "opportunities", "followed", "undecided", "total")]
    out = told.unionAll(listed).groupBy("detector").agg(*sums, F.max("by_hits").alias("by_hits"))
    everything = Window.partitionBy(F.lit(0))  # one row per detector
    out = out.withColumn("total", F.coalesce(F.max(F.when(F.col("detector").isNull(), F.col("total"))).over(everything), F.lit(0)))
    out = out.where("detector is not null and (by_hits or opportunities is not null)")
    of = F.col("total") - F.col("lost")
    share = F.when(of > 0, F.col("sessions") / of).otherwise(0.0)
    note = F.when(of < min_sessions, "").when(share > frequent_share, "frequent").when((F.col("hits") == 0) & F.col("by_hits"), "unobserved").otherwise("")
    return out.select(
        "detector", "hits", "sessions", of.alias("of"), share.alias("share"), note.alias("note"),
        "opportunities", "followed", "undecided", compliance_rate(F.col("opportunities"), F.col("followed"), min_opportunities).alias("rate"),
    )


_KEPT = "array<struct<name:string,c:struct<opportunities:bigint,followed:bigint,undecided:bigint>>>"


def _present(name, fold: dict[str, str]):
    """The present name of a detector."""
    if not fold:
        return name
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fold.items() for x in kv]), name), name)


def compliance_rate(opportunities, followed, least: int = MIN_OPPORTUNITIES):
    return F.when((opportunities > 0) & (opportunities >= least), followed / opportunities)


def rate_display(rate):
    """Whole percent; only a full rate shows 100 and only none shows 0. NULL stays NULL."""
    return F.when(rate.isNull(), F.lit(None).cast("int")).when(rate == 0, 0).when(rate == 1, 100).otherwise(F.greatest(F.lit(1), F.least(F.lit(99), F.round(rate * 100).cast("int"))))


def report_by_group(rows: DataFrame, by: str = "repo", top: int = 3) -> DataFrame:
    """(key, sessions, hits, top): by repository, or by stance, to each of which a row counts."""
    ok = row_status(rows).where("status = 'ok'")
    if by == "repo":
        keyed = ok.withColumn("key", F.coalesce(F.nullif("repo", F.lit("")), F.lit("(no repo)")))
    elif by == "stance":
        pairs = F.transform(F.map_entries("stances"), lambda e: F.concat_ws("=", e["key"], e["value"]))
        keyed = ok.withColumn("key", F.explode(F.when(F.coalesce(F.size("stances"), F.lit(0)) > 0, pairs).otherwise(F.array(F.lit("(no stances)")))))
    else:
        raise ValueError("by is repo or stance")
    # A row of its own counts the session, so the rows are grouped once; then one row per (key, detector) is left.
    told = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("detector"), F.lit(1).cast("long").alias("n"))), F.transform(F.map_entries("rules"), lambda e: F.struct(e["key"].alias("detector"), e["value"].alias("n"))))
    per = keyed.select("key", F.explode(told).alias("t")).groupBy("key", "t.detector").agg(F.sum("t.n").alias("n"))
    named = F.col("detector").isNotNull()
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(named.desc(), F.col("n").desc(), "detector")))
    best = F.array_sort(F.collect_list(F.when(named & (F.col("r") <= top), F.struct("r", "detector"))))
    return ranked.groupBy("key").agg(
        F.sum(F.when(~named, F.col("n"))).alias("sessions"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("hits"), F.transform(best, lambda x: x["detector"]).alias("top")
    )


def top_per_group(counts: DataFrame, k: int = 3) -> DataFrame:
    """(key, top): the ``k`` detectors with most hits; ties by name."""
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").desc(), "detector"))).where(F.col("r") <= k)
    return ranked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "detector"))), lambda x: x["detector"]).alias("top"))


def tool_counts(events: DataFrame) -> DataFrame:
    """Uses of three tools per session."""
    used = F.col("kind") == "tool_use"
    return events.groupBy("runtime", "session_id").agg(
        F.count_if(used & (F.col("name") == "WebSearch")).alias("web_searches"), F.count_if(used & (F.col("name") == "Agent")).alias("agents"), F.count_if(used & (F.col("name") == "AskUserQuestion")).alias("questions")
    )
