"""Fields that come, go, change name or type between the files of a stream; and one typed table of all lines.

Lines are loaded as path-value maps with raw types, statistics are gathered per file, path and type, and
neighbouring files are compared on these statistics alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.variants import json_objects, once
from logloom.storage import materialize

#: The kinds of record and of payload that runtimes write, by which a line's kind is known whatever the field is called.
RECORD_KINDS = ("session_meta", "turn_context", "response_item", "event_msg", "compacted")
PAYLOAD_KINDS = ("message", "function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output", "reasoning", "local_shell_call", "web_search_call")


def _kind(entries: Column, known: tuple[str, ...]) -> Column:
    named = F.filter(entries, lambda e: (e["type"] == "string") & e["value"].isin(*known))
    return F.coalesce(F.get(F.transform(named, lambda e: e["value"]), 0), F.lit(""))


def _entries(source: str, prefix: str, raw: bool) -> str:
    """SQL: the non-null fields of a variant object as structs of path, raw type and value (text of leaves, schema of containers)."""
    fields = f"map_entries(coalesce(try_variant_get({source}, '$', 'map<string,variant>'), cast(map() as map<string,variant>)))"
    typed = f"transform({fields}, e -> named_struct('key', e.key, 'value', e.value, 'is', coalesce(schema_of_variant(e.value), 'VOID')))"  # the schema of a value is found once
    return (
        f"transform(filter({typed}, e -> e.is <> 'VOID'), e -> named_struct("
        f"'path', concat('{prefix}', e.key), "
        "'type', case when e.is = 'STRING' then 'string' when startswith(e.is, 'OBJECT') then 'object' when startswith(e.is, 'ARRAY') then 'array' when e.is = 'BOOLEAN' then 'boolean' else 'number' end, "
        "'value', case when startswith(e.is, 'OBJECT') or startswith(e.is, 'ARRAY') then e.is else try_variant_get(e.value, '$', 'string') end"
        + (", 'raw', to_json(e.value)))" if raw else "))")
    )


def path_values(lines: DataFrame, body: str = "body", keep: list[str] | None = None, raw: bool = False) -> DataFrame:
    """Lines -> ``keep`` columns, ``kind`` (record kind / payload kind) and ``entries`` (path, type, value, and raw JSON if asked for).

    Paths are top-level fields and direct fields of ``payload``; null values are no entries. With ``raw`` a
    ``payload`` that is no object is an entry too. NULL, empty and unreadable lines, and lines that are no
    object, give no row.
    """
    keep = keep if keep is not None else [c for c in lines.columns if c != body]
    df = json_objects(lines, body, keep, "__v")
    both = F.struct(F.expr(_entries("__v", "", raw)).alias("top"), F.expr(_entries("try_variant_get(__v, '$.payload', 'variant')", "payload.", raw)).alias("pay"))
    df = df.select(*keep, once(both).alias("__e")).select(*keep, F.col("__e.top").alias("__top"), F.col("__e.pay").alias("__pay"))
    return df.select(
        *keep,
        F.concat(_kind(F.col("__top"), RECORD_KINDS), F.lit("/"), _kind(F.col("__pay"), PAYLOAD_KINDS)).alias("kind"),
        F.concat(F.filter("__top", lambda e: (e["path"] != "payload") | (F.lit(raw) & (e["type"] != "object"))), F.col("__pay")).alias("entries"),
    )


def value_sort(kind: Column, value: Column) -> Column:
    """What sort of value this is: a coarse class, with the prefix of identifiers, the digits-free form of single words, the keys of objects.

    A look at the first character decides which patterns can fit, so that few are tried.
    """
    word = F.lower(F.regexp_replace(value, r"\d+", "9"))
    first = F.substring(value, 1, 1)
    counted, lettered = first.between("0", "9") | (first == "-"), first.between("A", "Z") | first.between("a", "z")
    text = (
        F.when(value == "", "empty")
        .when(counted & value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), "instant")
        .when(counted & value.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number text")
        .when((counted | (first == "v")) & value.rlike(r"^v?\d+(\.\d+)+[\w.+-]*$"), "version")
        .when(lettered & F.contains(value, F.lit("://")) & value.rlike(r"^[a-z][a-z+]*://"), "address")
        .when((first.isin("/", "~") | lettered) & value.rlike(r"^(/|~/|[A-Za-z]:\\)[^\s]*$"), "path")
        .when(lettered & value.rlike(r"^[A-Za-z]+[_-][0-9a-f]{8,}$"), F.concat(F.lit("id "), F.regexp_extract(value, r"^([A-Za-z]+)", 1)))
        .when((counted | lettered) & value.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-"), "uuid")
        .when(~(counted | lettered) & value.rlike(r"^\s*[{]"), "object text")
        .when(~(counted | lettered) & value.rlike(r"^\s*[\[]"), "array text")
        .when(value.rlike(r"^[\x21-\x7e]+$"), F.concat(F.lit("word "), F.when(F.length(word) <= 32, word).otherwise(F.hex(F.xxhash64(word)))))  # a long word by its hash
        .otherwise("text")
    )
    number = value.try_cast("double")
    size = F.when(F.abs(number) >= 1e11, "epoch").when(number != F.floor(number), "fraction").otherwise("integer")
    return (
        F.when(kind == "string", text)
        .when(kind == "number", F.concat(F.lit("number "), size))
        .when(kind == "object", F.concat(F.lit("object "), value))
        .when(kind == "array", F.concat(F.lit("array "), F.regexp_extract(value, r"^ARRAY<(\w*)", 1)))
        .otherwise("boolean")
    )


#: The share of distinct words among a path's words from which on they count as made up for each record.
MADE_UP = 0.5
_FILES = "file_id long, stream_id string, written_at timestamp, piece int, place long, previous long"


def _neighbours(batches: Iterator) -> Iterator:
    """mapInArrow over sorted files: each with its predecessor inside the piece."""
    import pyarrow as pa
    from pyspark import TaskContext

    piece, stream, last, place = TaskContext.get().partitionId(), None, None, 0
    for batch in batches:
        files, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        previous, places = [], []
        for f, s in zip(files, streams):
            previous.append(last if s == stream else None)
            places.append(place)
            stream, last, place = s, f, place + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([piece] * len(files), pa.int32()), pa.array(places, pa.int64()), pa.array(previous, pa.int64())],
            names=["file_id", "stream_id", "written_at", "piece", "place", "previous"],
        )


def preceding_files(files: DataFrame) -> DataFrame:
    """(file_id, stream_id, written_at) -> (file_id, previous): the file before it in its stream by written_at, then file_id.

    Files are range-partitioned in that order, so a stream with a third of all files is read by many tasks;
    the first file of each piece takes its predecessor from the end of the piece before.
    """
    spark = files.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("stream_id", "written_at", "file_id")
    placed = materialize(files.select("file_id", "stream_id", "written_at").repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _FILES), "files")
    # One row per range partition, so ordering them all in one place is bounded by the number of partitions.
    edge = lambda by: by(F.struct("stream_id", "file_id"), "place")
    edges = placed.groupBy("piece").agg(edge(F.min_by).alias("head"), edge(F.max_by).alias("end"))
    before = (
        edges.withColumn("last", F.lag("end").over(Window.orderBy("piece")))
        .where(F.col("last.stream_id") == F.col("head.stream_id"))
        .select(F.col("head.file_id").alias("file_id"), F.col("last.file_id").alias("across"))
    )
    return placed.join(F.broadcast(before), "file_id", "left").select("file_id", F.coalesce("previous", "across").alias("previous")).where("previous is not null")


def schema_changes(lines: DataFrame) -> DataFrame:
    """(file_id, change_kind, old_path, new_path): each file against the one before it in its stream.

    ``lines`` has file_id, stream_id, written_at and body; other columns are ignored. Lines without file or
    stream do not count. Kinds: added (old_path ''), removed (new_path ''), renamed, retyped; a path's type
    in a file is that of most of its lines (ties: alphabetically first). Two paths are one renamed field if
    they stand at the same level, have the same type, occur in the same kinds of record (of those in both
    files) and hold values of the same sort (:func:`value_sort`), for single words also judged by all files
    that have the paths; of several partners the likeliest on both sides. Empty input gives no rows.
    """
    return changes_between(path_statistics(lines.where(_PLACED)))


#: Lines that stand in a file of a stream.
_PLACED = "file_id is not null and stream_id is not null and written_at is not null"


def path_statistics(lines: DataFrame) -> DataFrame:
    """Lines counted per file, kind, path, type and sort of value in one pass; the path '' stands for the line itself."""
    rows = path_values(lines.select(F.col("file_id").cast("long").alias("file_id"), "stream_id", "written_at", "body"), keep=["file_id", "stream_id", "written_at"])
    entry = F.explode(F.concat(F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("type"), F.lit("").alias("value"))), F.col("entries")))
    # A projection that holds a lambda is compiled by itself, in small methods; as part of a whole stage the patterns of
    # value_sort would make one method that is too long for the JVM to compile.
    path = F.element_at(F.transform(F.array("e.path"), lambda p: p), 1).alias("path")
    sort = F.when(F.col("e.path") != "", value_sort(F.col("e.type"), F.col("e.value"))).alias("sort")
    keys = ["file_id", "stream_id", "written_at", "kind", "path", "type", "sort"]
    sorted_values = rows.select("file_id", "stream_id", "written_at", "kind", entry.alias("e")).select(*keys[:4], path, F.col("e.type").alias("type"), sort)
    return materialize(sorted_values.groupBy(*keys).agg(F.count("*").alias("n")), "path-statistics")  # text in the keys, not in the aggregates: a hash aggregate without a sort


def changes_between(stats: DataFrame) -> DataFrame:
    """The changes of :func:`schema_changes` from the statistics of lines that all stand in a file of a stream."""
    files = stats.where("path = ''").groupBy("file_id").agg(F.min("stream_id").alias("stream_id"), F.min("written_at").alias("written_at"), F.collect_set("kind").alias("file_kinds"))
    pairs = preceding_files(files.drop("file_kinds"))
    by_type = stats.where("path <> ''").groupBy("file_id", "path", "type").agg(F.sum("n").alias("n"), F.collect_set("kind").alias("kinds"), F.collect_set("sort").alias("sorts"))
    paths = by_type.groupBy("file_id", "path").agg(F.min_by(F.struct("type", "kinds", "sorts"), F.struct(-F.col("n"), "type")).alias("s"))
    now = paths.join(pairs.select("file_id"), "file_id").select("file_id", "path", F.col("s").alias("new"))
    was = paths.join(pairs.select(F.col("file_id").alias("later"), F.col("previous").alias("file_id")), "file_id").select(F.col("later").alias("file_id"), "path", F.col("s").alias("old"))
    both = materialize(was.join(now, ["file_id", "path"], "full_outer").where("old is null or new is null or old.type <> new.type"), "path-changes")
    retyped = both.where("old is not null and new is not null").select("file_id", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"))

    level = F.col("path").startswith("payload.").alias("level")
    gone = both.where("new is null").select("file_id", level, F.col("path").alias("old_path"), F.col("old.type").alias("type"), "old")
    come = both.where("old is null").select("file_id", level, F.col("path").alias("new_path"), F.col("new.type").alias("type"), "new")
    kinds = pairs.join(files.select("file_id", F.col("file_kinds").alias("k_new")), "file_id").join(files.select(F.col("file_id").alias("previous"), F.col("file_kinds").alias("k_old")), "previous").drop("previous")
    # A pair of files has a handful of changed fields, so meeting on the file is no all-pairs join.
    met = gone.join(come, ["file_id", "level", "type"]).join(kinds, "file_id")
    shared = F.array_intersect("k_old", "k_new")
    met = met.withColumn("ko", F.array_intersect("old.kinds", shared)).withColumn("kn", F.array_intersect("new.kinds", shared))
    same_kinds = (F.size(F.array_except("ko", "kn")) == 0) & (F.size(F.array_except("kn", "ko")) == 0)
    met = met.where(same_kinds).select("file_id", "old_path", "new_path", "type", F.size("ko").alias("n_kinds"), F.arrays_overlap("old.sorts", "new.sorts").alias("here"), _coarse("old.sorts").alias("co"), _coarse("new.sorts").alias("cn"))
    met = materialize(met.where(F.arrays_overlap("co", "cn")), "rename-candidates")

    # For words, the vocabulary of a path over all files decides where two small files happen to share no word. Paths
    # whose words hardly ever come twice hold names made up for each record, which are of one sort among themselves.
    words = stats.where("path <> '' and sort like 'word %'").groupBy("path", "type", "sort").agg(F.sum("n").alias("n"))
    wanted = met.select("old_path", "new_path", "type").distinct()
    common = (
        wanted.join(words.select(F.col("path").alias("old_path"), "type", "sort"), ["old_path", "type"])
        .join(words.select(F.col("path").alias("new_path"), "type", "sort"), ["new_path", "type", "sort"])
        .groupBy("old_path", "new_path", "type")
        .agg(F.count("*").alias("common"))
    )
    size = words.groupBy("path", "type").agg(F.count("*").alias("n"), F.sum("n").alias("values"))
    of = lambda side: size.select(F.col("path").alias(f"{side}_path"), "type", F.col("n").alias(f"n_{side}"), (F.col("n") > F.col("values") * MADE_UP).alias(f"made_up_{side}"))
    common = wanted.join(common, ["old_path", "new_path", "type"], "left").join(of("old"), ["old_path", "type"]).join(of("new"), ["new_path", "type"])
    alike = F.when(F.col("made_up_old") & F.col("made_up_new"), 1.0).otherwise(F.coalesce("common", F.lit(0)) / F.least("n_old", "n_new"))
    common = common.select("old_path", "new_path", "type", alike.alias("alike"))
    scored = met.join(common, ["old_path", "new_path", "type"], "left").withColumn("alike", F.coalesce("alike", F.lit(0.0)))
    scored = scored.where(F.col("here") | (F.col("alike") > 0)).withColumn("rank", F.struct("here", "alike", "n_kinds", F.col("new_path")))
    best_old = scored.groupBy("file_id", "old_path").agg(F.max_by("new_path", "rank").alias("new_path"))
    best_new = scored.groupBy("file_id", "new_path").agg(F.max_by("old_path", F.struct("here", "alike", "n_kinds", "old_path")).alias("old_path"))
    renamed = best_old.join(best_new, ["file_id", "old_path", "new_path"])
    renamed = materialize(renamed.select("file_id", "old_path", "new_path"), "renamed")
    removed = gone.join(renamed, ["file_id", "old_path"], "left_anti").select("file_id", F.lit("removed").alias("change_kind"), "old_path", F.lit("").alias("new_path"))
    added = come.join(renamed, ["file_id", "new_path"], "left_anti").select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_path"), "new_path")
    return retyped.unionAll(renamed.select("file_id", F.lit("renamed").alias("change_kind"), "old_path", "new_path")).unionAll(removed).unionAll(added)


def _coarse(sorts: str) -> Column:
    """Sorts without the spelling of words; the rest must agree as it stands."""
    return F.array_distinct(F.transform(F.col(sorts), lambda s: F.when(s.startswith("word "), F.lit("word")).otherwise(s)))


def _groups(paths: list[str], pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Paths that renames join, directly or over others; the order of ``paths`` is kept."""
    head = {p: p for p in paths}

    def find(p: str) -> str:
        while head[p] != p:
            p = head[p]
        return p

    for a, b in pairs:
        head[find(b)] = find(a)
    groups: dict[str, list[str]] = {}
    for p in paths:
        groups.setdefault(find(p), []).append(p)
    return list(groups.values())


def consistent_columns(lines: DataFrame, keep: list[str], most: int = 1000) -> dict[str, tuple[str, list[str]]]:
    """The columns for :func:`consistent_table`: one for each field that any line holds, from the statistics over all files.

    Paths that were renamed into each other anywhere are one field, unless they stand side by side in files
    (in the same kind of record) more often than one gives way to the other. A field's type is that of most of
    its values (ties: alphabetically first), its name that of its most frequent path. The ``most`` frequent
    paths get columns, so that names made from data make no boundless table; :func:`consistent_table` reports
    the values of all others.
    """
    stats = path_statistics(lines)
    held = stats.where("path <> ''")
    whole = F.coalesce(F.sum(F.when(F.col("sort") == "number fraction", F.col("n"))), F.lit(0)).alias("fractions")
    counts = held.groupBy("path", "type").agg(F.sum("n").alias("n"), whole)
    kept = counts.groupBy("path").agg(F.sum("n").alias("lines"), F.collect_list(F.struct("type", "n", "fractions")).alias("types")).orderBy(F.desc("lines"), "path").limit(most).collect()
    types = {r["path"]: r["types"] for r in kept}
    pairs = changes_between(stats.where(_PLACED)).where("change_kind = 'renamed'").groupBy("old_path", "new_path").agg(F.count("*").alias("n"))
    pairs = materialize(pairs.groupBy(F.least("old_path", "new_path").alias("a"), F.greatest("old_path", "new_path").alias("b")).agg(F.sum("n").alias("n")), "renamed-anywhere")
    stands = held.where(_PLACED).select("file_id", "kind", "path").distinct()
    beside = pairs.join(stands.withColumnRenamed("path", "a"), "a").join(stands.withColumnRenamed("path", "b"), ["b", "file_id", "kind"]).groupBy("a", "b").agg(F.count_distinct("file_id").alias("beside"))
    joined = pairs.join(beside, ["a", "b"], "left").where(F.col("n") > F.coalesce("beside", F.lit(0))).select("a", "b").orderBy("a", "b").collect()
    columns, taken = {}, {k.lower() for k in [*keep, "failed_casts", "other_paths"]}
    for group in _groups(list(types), [(r["a"], r["b"]) for r in joined if r["a"] in types and r["b"] in types]):
        votes, fractions = {}, 0
        for t in (t for p in group for t in types[p]):
            votes[t["type"]] = votes.get(t["type"], 0) + t["n"]
            fractions += t["fractions"]
        kind = min(votes, key=lambda t: (-votes[t], t))
        base = name = re.sub(r"\W", "_", group[0])
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        columns[name] = (kind if kind != "number" else "double" if fractions else "bigint", group)
    return columns


def _at(paths: list[str]):
    return lambda e: e["path"].isin(*paths)


def consistent_table(lines: DataFrame, columns: dict[str, tuple[str, list[str]]], keep: list[str] | None = None) -> DataFrame:
    """All lines as one typed table, with what could not be cast and what has no column.

    ``columns``: name -> (SQL type, paths that hold it, most wanted first); the types ``object`` and ``array``
    hold JSON text of just that type. Adds each column, ``failed_casts``, an array of (column, path, type,
    value) for values that are there but do not fit (such a column is NULL), and ``other_paths``, an array of
    (path, type, value) for values that stand in no column: their path has none, or a more wanted path of the
    same column holds a value too. Columns that ``keep`` and ``columns`` both name would clash and are refused.
    """
    keep = keep if keep is not None else [c for c in lines.columns if c != "body"]
    clash = set(keep) & {*columns, "failed_casts", "other_paths"}
    if clash:
        raise ValueError(f"columns named twice: {sorted(clash)}")
    text = lambda e: F.when(e["type"].isin("object", "array"), e["raw"]).otherwise(e["value"])
    df = path_values(lines, keep=keep, raw=True).select(*keep, once(F.col("entries")).alias("entries"))
    found = []
    for i, (sql, paths) in enumerate(columns.values()):
        hits = F.filter("entries", _at(paths))
        if len(paths) > 1:
            hits = F.array_compact(F.array(*[F.get(F.filter(hits, _at([p])), 0) for p in paths]))
        found.append(F.get(hits, 0).alias(f"e{i}"))
    df = df.select("*", once(F.struct(*found) if found else F.struct(F.lit(0).alias("none"))).alias("__found"))
    cast = []
    for i, (sql, _) in enumerate(columns.values()):
        first = F.col(f"__found.e{i}")
        value = F.when(first["type"] == sql, first["raw"]) if sql in ("object", "array") else text(first).try_cast(sql)
        cast.append(value.alias(f"c{i}"))
    df = df.select("*", once(F.struct(*cast) if cast else F.struct(F.lit(0).alias("none"))).alias("__cast"))
    out, failures = [], []
    for i, name in enumerate(columns):
        first, value = F.col(f"__found.e{i}"), F.col(f"__cast.c{i}")
        out.append(value.alias(name))
        failures.append(F.when(first.isNotNull() & value.isNull(), F.struct(F.lit(name).alias("column"), first["path"].alias("path"), first["type"].alias("type"), text(first).alias("value"))))
    placed = F.array(*[F.col(f"__found.e{i}") for i in range(len(columns))])
    others = F.filter("entries", lambda e: ~F.coalesce(F.array_contains(placed, e), F.lit(False))) if columns else F.col("entries")
    nothing = F.expr("cast(array() as array<struct<column:string,path:string,type:string,value:string>>)")
    return df.select(
        *keep,
        *out,
        (F.array_compact(F.array(*failures)) if failures else nothing).alias("failed_casts"),
        F.transform(others, lambda e: F.struct(e["path"].alias("path"), e["type"].alias("type"), text(e).alias("value"))).alias("other_paths"),
    )
