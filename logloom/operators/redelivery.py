"""Messages delivered more than once: an index of identifiers that arriving batches are held against.

An identifier is 128 bits of hash over its parts. The index is a folder of immutable *runs*
(:mod:`logloom.operators.sortedruns`): identifiers with their winning delivery, by hash prefix, sorted. A batch
is first deduplicated where it lies, piece by piece, so that a message with a third of all deliveries shrinks
before it moves; what is left, and nothing else, is shuffled by hash prefix. A task opens the run files of its
prefixes, binary-searches them from the newest run to the oldest, and writes the novel or better identifiers as
the next run. Full levels of runs are merged prefix by prefix, without a shuffle. Which runs count is published
by a rename, so a failed batch leaves nothing behind, a lost executor repeats its tasks and no more, and the
next job goes on where this one ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.variants import json_objects
from logloom.operators.sortedruns import PrefixReader, due, merged, newest_first, prefix_of, write_run
from logloom.storage import forget_versions, latest_version, materialize, publish_version, qualified, remove, scratch

#: Deliveries that are deduplicated together before the shuffle.
LOCAL_ROWS = 200_000
#: Runs of one level after which they are merged into one of the next.
MERGE_EVERY = 3
#: Bits of the hash prefix of a new index: 2 ** PREFIX_BITS prefixes.
PREFIX_BITS = 4
_IDS = "src string, h1 long, h2 long, batch_no long, row_id long, lost boolean"
_OUT = "what string, prefix int, src string, h1 long, h2 long, batch_no long, row_id long"


def line_deliveries(lines: DataFrame) -> DataFrame:
    """session_lines -> (src, h1, h2, batch_no, row_id). Copies agree in session, message.id and the first block's apiBlockIndex.

    Rows without session or id, or with an unreadable message, are no copies and are left out. An absent
    or odd apiBlockIndex counts as 0, a NULL batch_no as lower than any.
    """
    return (
        json_objects(lines.where("session_id is not null and session_id <> ''"), "message", ["session_id", "batch_no", "line_id"])
        .select(
            F.lit("session_lines").alias("src"),
            "session_id",
            F.expr("try_variant_get(v, '$.id', 'string')").alias("id"),
            F.expr("coalesce(try_variant_get(v, '$.content[0].apiBlockIndex', 'bigint'), try_variant_get(v, '$.content.apiBlockIndex', 'bigint'), 0)").alias("block"),
            F.col("batch_no").cast("long").alias("batch_no"),
            F.col("line_id").cast("long").alias("row_id"),
        )
        .transform(_identified)
    )


def record_deliveries(records: DataFrame) -> DataFrame:
    """chat_records -> the same columns; copies agree in session and the record's own id."""
    return (
        json_objects(records.where("session_id is not null and session_id <> ''"), "body", ["session_id", "batch_no", "record_id"])
        .select(
            F.lit("chat_records").alias("src"),
            "session_id",
            F.expr("try_variant_get(v, '$.id', 'string')").alias("id"),
            F.lit(0).cast("long").alias("block"),
            F.col("batch_no").cast("long").alias("batch_no"),
            F.col("record_id").cast("long").alias("row_id"),
        )
        .transform(_identified)
    )


def _identified(df: DataFrame) -> DataFrame:
    parts = ("src", "session_id", "id", "block")
    return df.where("id is not null and id <> ''").select(
        "src",
        F.xxhash64(*parts).alias("h1"),
        F.xxhash64(F.lit(0x5EED), *reversed(parts)).alias("h2"),
        F.coalesce("batch_no", F.lit(-(1 << 62))).alias("batch_no"),
        "row_id",
    )


def _beaten(h1, h2, batch_no, row_id, order) -> tuple[np.ndarray, np.ndarray]:
    """Of each identifier the greatest (batch_no, row_id) wins: (winners, beaten), as places; ``order`` sorts by all four.

    The same delivery twice (equal in all four) counts once.
    """
    a, b, c, d = (x[order] for x in (h1, h2, batch_no, row_id))
    same = np.zeros(len(order), bool)
    same[:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(order), bool)
    twice[:-1] = same[:-1] & (c[1:] == c[:-1]) & (d[1:] == d[:-1])
    return order[~same], order[same & ~twice]


def _local(batches: Iterator) -> Iterator:
    """mapInArrow: marks deliveries that another one of the same piece beats."""
    import pyarrow as pa

    def done(held: list) -> Iterator:
        table = pa.Table.from_batches(held).combine_chunks()
        h1, h2, b, r = (table[c].to_numpy() for c in ("h1", "h2", "batch_no", "row_id"))
        for places, lost in zip(_beaten(h1, h2, b, r, np.lexsort((r, b, h2, h1))), (False, True)):
            part = table.take(pa.array(places))
            yield from part.append_column("lost", pa.array(np.full(len(places), lost))).combine_chunks().to_batches()

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= LOCAL_ROWS:
            yield from done(held)
            held, rows = [], 0
    if held:
        yield from done(held)


_KEY = ("h1", "h2", "batch_no", "row_id")


def _probe(runs: list[str]):
    """mapInArrow over a batch sorted by prefix and :data:`_KEY`; ``runs`` from the oldest to the newest.

    One Arrow batch is held at a time, with the row groups of the runs that it reaches into.
    """

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(what: str, prefix: int, cols: dict, src) -> pa.RecordBatch:
            n = len(cols["h1"])
            return pa.RecordBatch.from_arrays(
                [pa.array([what] * n, pa.string()), pa.array(np.full(n, prefix, np.int32)), src, *(pa.array(cols[c]) for c in _KEY)], names=["what", "prefix", "src", *_KEY]
            )

        readers: tuple[int, list] = (-1, [])

        def settle(table: pa.Table) -> Iterator:
            """Novel and better identifiers of rows of one prefix, each of which is whole."""
            nonlocal readers
            prefix = table["prefix"][0].as_py()
            if readers[0] != prefix:
                readers = (prefix, [PrefixReader(r, prefix, ["src", "batch_no", "row_id"]) for r in reversed(runs)])
            col, src = {c: table[c].to_numpy() for c in _KEY}, table["src"].combine_chunks()
            wins, beaten = _beaten(*(col[c] for c in _KEY), np.arange(len(src)))
            lost = np.zeros(len(wins), bool)
            for which, old, place in newest_first(readers[1], col["h1"][wins], col["h2"][wins]):
                new_b, new_r, old_b, old_r = col["batch_no"][wins[which]], col["row_id"][wins[which]], old["batch_no"][place], old["row_id"][place]
                better = (new_b > old_b) | ((new_b == old_b) & (new_r > old_r))
                again = (new_b == old_b) & (new_r == old_r)  # this very delivery was taken before
                lost[which[~better]] = True
                beaten = np.concatenate([beaten, wins[which[~better & ~again]]])
                out = place[better]
                yield rows("drop", -1, {c: old[c][out] for c in _KEY}, old["src"].take(pa.array(out)))
            new = wins[~lost]
            for what, p, at in (("drop", -1, beaten), ("run", prefix, new)):
                yield rows(what, p, {c: col[c][at] for c in _KEY}, src.take(pa.array(at)))

        open_: pa.Table | None = None  # rows of the last identifier, of which more may come
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([open_, table]) if open_ is not None else table).combine_chunks()
            prefix, h1, h2 = (table[c].to_numpy() for c in ("prefix", "h1", "h2"))
            whole = int(np.flatnonzero((prefix != prefix[-1]) | (h1 != h1[-1]) | (h2 != h2[-1]))[-1]) + 1 if (h1 != h1[-1]).any() or (h2 != h2[-1]).any() or (prefix != prefix[-1]).any() else 0
            edges = [0, *(np.flatnonzero(np.diff(prefix[:whole])) + 1), whole]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    yield from settle(table.slice(a, b - a).combine_chunks())
            open_ = table.slice(whole)
            if open_.num_rows > 2:  # one identifier only: its beaten deliveries go at once
                wins, beaten = _beaten(*(open_[c].to_numpy() for c in _KEY), np.arange(open_.num_rows))
                gone = open_.take(pa.array(beaten)).combine_chunks()
                yield rows("drop", -1, {c: gone[c].to_numpy() for c in _KEY}, gone["src"].combine_chunks())
                open_ = open_.take(pa.array(wins))
        if open_ is not None and open_.num_rows:
            yield from settle(open_.combine_chunks())

    return probe


class IdentifierIndex:
    """The persisted index in ``folder`` (a scratch folder by default); a folder that holds one is taken up where it was left.

    ``prefix_bits`` is fixed when the index is made: an index of N identifiers in P prefixes has files of N / P
    of them. A task holds an Arrow batch and a row group per run, whatever the size of batch and index. One job
    writes at a time: of two that publish the same step one fails, and leaves the index as the other made it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, prefix_bits: int = PREFIX_BITS, merge_every: int = MERGE_EVERY):
        self.spark, self.folder = spark, qualified(spark, folder or scratch(spark, "identifier-index"))
        self.merge_every = merge_every
        self.state = latest_version(spark, self.folder) or {"version": 0, "prefix_bits": prefix_bits, "runs": [], "batches": {}}

    @property
    def runs(self) -> list[str]:
        """The folders of the runs that count, from the oldest to the newest."""
        return [f"{self.folder}/{r['name']}" for r in self.state["runs"]]

    def _publish(self, **changes) -> None:
        state = {**self.state, **changes, "version": self.state["version"] + 1}
        publish_version(self.spark, self.folder, state)
        self.state = state

    def _dropped(self, name: str) -> DataFrame:
        return self.spark.read.schema(_OUT).parquet(f"{self.folder}/{name}").where("what = 'drop'").select("src", "row_id")

    def ingest(self, deliveries: DataFrame, batch: str | None = None) -> DataFrame:
        """Takes one batch (columns of :func:`line_deliveries`, optionally ``lost``) into the index.

        Returns (src, row_id) of the copies to drop: beaten rows of the batch, and rows of earlier batches
        that a row of this one replaces. An empty batch drops nothing. A delivery that is already in the index
        changes nothing. A ``batch`` with a name that was published before is not taken again; its drops are
        returned as they were.
        """
        if batch is not None and batch in self.state["batches"]:
            return self._dropped(self.state["batches"][batch])
        if "lost" not in deliveries.columns:
            deliveries = deliveries.mapInArrow(_local, _IDS)
        step = self.state["version"] + 1
        name = f"run-{step:06d}-{uuid.uuid4().hex[:8]}"
        prefix = prefix_of("h1", self.state["prefix_bits"]).alias("prefix")
        # Beaten rows of the batch go out as they are; only the rest moves.
        lost = deliveries.where("lost").select(F.lit("drop").alias("what"), F.lit(-1).alias("prefix"), "src", *_KEY)
        incoming = deliveries.where("not lost").select(prefix, "src", *_KEY).repartition("prefix").sortWithinPartitions("prefix", *_KEY)
        write_run(incoming.mapInArrow(_probe(self.runs), _OUT).unionAll(lost), f"{self.folder}/{name}")
        batches = {**self.state["batches"], **({batch: name} if batch is not None else {})}
        self._publish(runs=[*self.state["runs"], {"name": name, "level": 0}], batches=batches)
        out = self._dropped(name)
        self._merge()
        return out

    def _merge(self) -> None:
        """Merges full levels and removes what they consisted of; the drops of each batch stay readable."""
        while n := due(self.state["runs"], self.merge_every):
            old = self.state["runs"][-n:]
            name = f"run-{self.state['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
            prefixes = self.spark.range(1 << self.state["prefix_bits"]).select(F.col("id").cast("int").alias("prefix"))
            job = merged([f"{self.folder}/{r['name']}" for r in old], ["src", "batch_no", "row_id"], _OUT)
            write_run(prefixes.mapInArrow(job, _OUT), f"{self.folder}/{name}")
            self._publish(runs=[*self.state["runs"][:-n], {"name": name, "level": old[-1]["level"] + 1}])
            for r in old:
                remove(self.spark, f"{self.folder}/{r['name']}/what=run")
            forget_versions(self.spark, self.folder, self.state["version"] - 2)


def redelivered(deliveries: DataFrame, waves: int = 4, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(src, row_id) of all copies but one of every message: that of the greatest batch_no, then row_id, stays.

    The deliveries are extracted once, then ``waves`` ranges of batch_no, of about equal size, arrive at a new
    index one after the other, as they would in daily operation; the number of ranges changes nothing in the
    result. Ties in batch_no fall into one range. Physical rows that repeat a row_id are one delivery. Empty
    input gives no rows.
    """
    spark = deliveries.sparkSession
    ids = materialize(deliveries.mapInArrow(_local, _IDS), "deliveries")
    bounds = ids.select(F.percentile_approx("batch_no", [i / waves for i in range(1, waves)], 1000)).first()[0] or [] if waves > 1 else []
    bounds = sorted(set(bounds))
    index, out = IdentifierIndex(spark, prefix_bits=prefix_bits), None
    for low, high in zip([None, *bounds], [*bounds, None]):
        wave = ids
        if low is not None:
            wave = wave.where(F.col("batch_no") > low)
        if high is not None:
            wave = wave.where(F.col("batch_no") <= high)
        dropped = index.ingest(wave)
        out = dropped if out is None else out.unionAll(dropped)
    return out.distinct()
