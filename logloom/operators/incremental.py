"""Only new or changed keys per run, told by Merkle trees over key ranges, with the tree kept between runs.

A key's state is its newest stamp; keys are ordered by a 64-bit hash, the hash space is cut into
``FANOUT ** depth`` equal ranges (the leaves), and a leaf's digest is the sum of the hashes of its keys' states.
Inner nodes mix their children's digests. A run compares the tree of what it sees with the saved one from the
root downwards, only below nodes whose digests differ; the leaves reached hold all keys that can have changed,
and only their saved states are opened.

What a run puts out (the changed keys with their new states) is also the newest piece of the saved states: both
are one run of :mod:`logloom.operators.sortedruns`. With the tree that belongs to it, it is published by one
rename, so a run that fails leaves nothing that the next one would skip or repeat.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.instants import instant_micros
from logloom.operators.sortedruns import PrefixReader, due, merged, newest_first, prefix_of, write_run
from logloom.storage import arrow_filesystem, exists, filesystem, forget_versions, latest_version, publish_version, qualified, remove, scratch

FANOUT = 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class MerkleTree:
    """Digests of key ranges, level by level; ``levels[0]`` are the leaves, ``levels[-1]`` is the root alone."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [leaves.astype(np.uint64)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1].reshape(-1, FANOUT)
            place = np.arange(1, FANOUT + 1, dtype=np.uint64)
            self.levels.append(_mix(below + place).sum(axis=1, dtype=np.uint64))

    def changed(self, saved: MerkleTree) -> np.ndarray:
        """The leaves that differ from ``saved``, found by descending only where digests differ."""
        nodes = np.zeros(1, np.int64)
        for mine, other in zip(reversed(self.levels), reversed(saved.levels)):
            nodes = nodes[mine[nodes] != other[nodes]]
            if mine is not self.levels[0]:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return nodes


def snapshot_stamp() -> Column:
    """The stamp of a session_index row: last_updated, or last_message_ts where that is no date-time."""
    return F.coalesce(instant_micros(F.col("last_updated")), instant_micros(F.col("last_message_ts")))


def successful_runs(run_log: DataFrame) -> list[tuple[int, datetime]]:
    """(run_id, cutoff) of the runs with status ok, in order of cutoff. A log row per run of a job: a small list."""
    rows = run_log.where("status = 'ok' and cutoff_at is not null and run_id is not null").select("run_id", F.unix_micros(F.col("cutoff_at").cast("timestamp")).alias("c")).distinct()
    return sorted(((r["run_id"], r["c"]) for r in rows.collect()), key=lambda x: (x[1], x[0]))


_OUT = "what string, prefix int, h1 long, h2 long, key string, stamp long, snap long, run_id long"
_CHANGED = "key string, stamp long, snap long, run_id long"


def _digests(h1: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The hash of each key's state."""
    return _mix(h1.view(np.uint64) ^ _mix(stamp.view(np.uint64)))


def _leaf(h1: np.ndarray, depth: int) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(64 - 4 * depth)).astype(np.int64)


def _compare(runs: list[str], tree: str | None, depth: int, whole: bool, run_id: int):
    """mapInArrow over rows sorted by prefix and key, one row per key: what changed, and the new digests of the leaves."""

    def one_range(table, prefix: int, saved: np.ndarray) -> Iterator:
        import pyarrow as pa

        h1, h2, stamp, snap = (table[c].to_numpy() for c in ("h1", "h2", "stamp", "snap"))
        keys = table["key"].combine_chunks()
        # A range is the subtree below one node of the first level; leaves are counted from its first one.
        per = FANOUT ** (depth - 1)
        leaf = _leaf(h1, depth) - prefix * per
        now = np.zeros(per, np.uint64) if whole else saved.copy()
        np.add.at(now, leaf, _digests(h1, stamp))
        differ = np.zeros(per, bool)
        differ[MerkleTree(now).changed(MerkleTree(saved))] = True
        at = np.flatnonzero(differ[leaf])  # all other keys are as they were saved
        was = np.full(len(at), np.iinfo(np.int64).min)
        for which, cols, place in newest_first([PrefixReader(r, prefix, ["stamp"]) for r in reversed(runs)], h1[at], h2[at]):
            was[which] = cols["stamp"][place]
        newer = stamp[at] > was
        known = newer & (was != np.iinfo(np.int64).min)
        leaves = saved.copy()
        np.subtract.at(leaves, leaf[at[known]], _digests(h1[at[known]], was[known]))
        at = at[newer]
        np.add.at(leaves, leaf[at], _digests(h1[at], stamp[at]))
        n, take = len(at), pa.array(at)
        full = lambda v, k, t: pa.array(np.full(k, v), t)
        names = [c.split()[0] for c in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(["run"] * n, pa.string()), full(prefix, n, pa.int32()), pa.array(h1[at]), pa.array(h2[at]), keys.take(take), pa.array(stamp[at]), pa.array(snap[at]), full(run_id, n, pa.int64())], names=names)
        moved = np.flatnonzero(leaves != saved)
        m = len(moved)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["tree"] * m, pa.string()), full(-1, m, pa.int32()), pa.array(moved + prefix * per), pa.array(leaves[moved].view(np.int64)), pa.nulls(m, pa.string()), full(0, m, pa.int64()), full(0, m, pa.int64()), full(run_id, m, pa.int64())], names=names
        )

    def job(batches: Iterator) -> Iterator:
        import pyarrow as pa

        per = FANOUT ** (depth - 1)
        saved = np.zeros(FANOUT**depth, np.uint64) if tree is None else _load(tree)
        held: list = []

        def flush() -> Iterator:
            table = pa.Table.from_batches(held).combine_chunks()
            prefix = table["prefix"][0].as_py()
            yield from one_range(table, prefix, saved[prefix * per : (prefix + 1) * per])

        for batch in batches:
            edges = [0, *(np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if held and held[0].column(0)[0].as_py() != batch.column(0)[a].as_py():
                        yield from flush()
                        held.clear()
                    held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return job


def _load(uri: str) -> np.ndarray:
    fs, path = arrow_filesystem(uri)
    with fs.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))


class ChangeFeed:
    """A persisted job in ``folder``: each :meth:`run` returns the keys that are new or changed since the last published run.

    ``depth`` is the depth of the tree and fixed when the feed is made: ``FANOUT ** depth`` leaves of 8 bytes are
    all that the driver and each task hold of it. A task holds the rows of one run that fall into one of the
    FANOUT ** 1 ranges below the root; of the saved states it opens only row groups that can hold their keys.
    One job writes at a time: of two that publish the same run one fails.
    """

    def __init__(self, spark: SparkSession, folder: str, depth: int = 3, merge_every: int = 8):
        if depth < 1:
            raise ValueError("a tree has a depth of 1 or more")
        self.spark, self.folder, self.merge_every = spark, qualified(spark, folder.rstrip("/")), merge_every
        self.state = latest_version(spark, self.folder) or {"version": 0, "depth": depth, "runs": [], "tree": None, "cutoff": None, "outputs": []}

    @property
    def cutoff(self) -> int | None:
        """Up to where the last published run saw, as given to it."""
        return self.state["cutoff"]

    def run(self, rows: DataFrame, cutoff: int | None = None, whole: bool = False, run_id: int = 0, folded: bool = False) -> DataFrame:
        """Takes ``rows`` (key string, stamp long, snap long) and returns (key, stamp, snap, run_id) of what changed.

        ``rows`` are what arrived since the last run (after :attr:`cutoff`), or with ``whole`` everything visible
        now; ``folded`` says that they hold a key once. A key is changed if its newest stamp is newer than at the last published run, or it is new; ``snap``
        is the least of the rows with that stamp. Rows with a NULL key or stamp do not count; a NULL snap comes
        after all others. Repeated rows change nothing. A run that is already published (same ``run_id`` and
        ``cutoff``) returns what it put out then.
        """
        spark, depth = self.spark, self.state["depth"]
        for done in self.state["outputs"]:
            if cutoff is not None and done["cutoff"] == cutoff and done["run_id"] == run_id:
                return self._output(done["name"])
        number = self.state["version"] + 1
        name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        runs = [f"{self.folder}/{r['name']}" for r in self.state["runs"]]
        tree = self.state["tree"] and f"{self.folder}/{self.state['tree']}"
        rows = rows.where("key is not null and stamp is not null").select("key", "stamp", F.coalesce("snap", F.lit((1 << 63) - 1)).alias("snap"))
        if not folded:
            rows = rows.groupBy("key").agg(F.max(F.struct("stamp", (-F.col("snap")).alias("m"))).alias("m")).select("key", F.col("m.stamp").alias("stamp"), (-F.col("m.m")).alias("snap"))
        hashed = rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key").alias("h2"), "key", "stamp", "snap")
        ranges = hashed.select(prefix_of("h1", 4).alias("prefix"), "*").repartition("prefix").sortWithinPartitions("prefix", "h1", "h2")
        write_run(ranges.mapInArrow(_compare(runs, tree, depth, whole, run_id), _OUT), f"{self.folder}/{name}")
        leaves = _load(tree) if tree else np.zeros(FANOUT**depth, np.uint64)
        if exists(spark, f"{self.folder}/{name}/what=tree"):
            at, digests = self._new_digests(name)
            leaves = leaves.copy()
            leaves[at] = digests
        self._save(f"{self.folder}/{name}/tree.npy", leaves)
        root = int(MerkleTree(leaves).levels[-1][0])
        outputs = [*self.state["outputs"], {"name": name, "run_id": run_id, "cutoff": cutoff}]
        self._publish(runs=[*self.state["runs"], {"name": name, "level": 0}], tree=f"{name}/tree.npy", cutoff=cutoff, outputs=outputs, root=root)
        self._merge()
        return self._output(name)

    def outputs(self) -> DataFrame:
        """(key, stamp, snap, run_id) of what all published runs put out."""
        return self._output(*[o["name"] for o in self.state["outputs"]])

    def verify(self) -> bool:
        """Whether the saved tree is that of the saved states: false if a file was lost or altered."""
        states = None
        for age, r in enumerate(self.state["runs"]):
            if exists(self.spark, f"{self.folder}/{r['name']}/what=run"):
                part = self.spark.read.schema("h1 long, h2 long, stamp long").parquet(f"{self.folder}/{r['name']}/what=run").select("*", F.lit(age).alias("age"))
                states = part if states is None else states.unionAll(part)
        leaves, depth = np.zeros(FANOUT ** self.state["depth"], np.uint64), self.state["depth"]
        if states is not None:

            def digests(batches: Iterator) -> Iterator:
                import pyarrow as pa

                for b in batches:
                    h1, stamp = b.column(0).to_numpy(), b.column(1).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(_leaf(h1, depth)), pa.array(_digests(h1, stamp).view(np.int64))], names=["leaf", "digest"])

            newest = states.groupBy("h1", "h2").agg(F.max_by("stamp", "age").alias("stamp")).select("h1", "stamp").mapInArrow(digests, "leaf long, digest long")
            xor = newest.groupBy("leaf").agg(F.collect_list("digest").alias("all")).select("leaf", F.expr("aggregate(all, cast(0 as decimal(38,0)), (a, x) -> cast(a + x as decimal(38,0)))").alias("sum"))
            for row in xor.toLocalIterator():  # at most one row per leaf
                leaves[row["leaf"]] = np.uint64(int(row["sum"]) % (1 << 64))
        saved = _load(f"{self.folder}/{self.state['tree']}") if self.state["tree"] else np.zeros_like(leaves)
        return bool((leaves == saved).all())

    def _output(self, *names: str) -> DataFrame:
        paths = [p for n in names if exists(self.spark, p := f"{self.folder}/{n}/what=run")]
        if not paths:
            return self.spark.createDataFrame([], _CHANGED)
        return self.spark.read.schema(_CHANGED).option("recursiveFileLookup", "true").parquet(*paths)

    def _new_digests(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, digests) that a run moved: at most all leaves of the tree."""
        import pyarrow.parquet as pq
        from pyarrow import fs as arrow_fs

        fs, root = arrow_filesystem(f"{self.folder}/{name}/what=tree/prefix=-1")
        files = [i.path for i in fs.get_file_info(arrow_fs.FileSelector(root)) if i.base_name.endswith(".parquet")]
        parts = [pq.ParquetFile(fs.open_input_file(f)).read(columns=["h1", "h2"]) for f in files]
        return np.concatenate([p["h1"].to_numpy() for p in parts]), np.concatenate([p["h2"].to_numpy() for p in parts]).view(np.uint64)

    def _save(self, path: str, leaves: np.ndarray) -> None:
        fs, p = filesystem(self.spark, path)
        buffer = io.BytesIO()
        np.save(buffer, leaves)
        stream = fs.create(p, True)
        stream.write(bytearray(buffer.getvalue()))
        stream.close()

    def _publish(self, **changes) -> None:
        state = {**self.state, **changes, "version": self.state["version"] + 1}
        publish_version(self.spark, self.folder, state)
        self.state = state

    def _merge(self) -> None:
        """Merges full levels of saved states, range by range, without a shuffle. Outputs stay as they are."""
        while n := due(self.state["runs"], self.merge_every):
            old = self.state["runs"][-n:]
            name = f"s{self.state['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            prefixes = self.spark.range(FANOUT).select(F.col("id").cast("int").alias("prefix"))
            job = merged([f"{self.folder}/{r['name']}" for r in old], ["key", "stamp", "snap", "run_id"], _OUT)
            write_run(prefixes.mapInArrow(job, _OUT), f"{self.folder}/{name}")
            self._publish(runs=[*self.state["runs"][:-n], {"name": name, "level": old[-1]["level"] + 1}])
            for r in old:
                if r["level"]:  # a state made by merging; those of level 0 are outputs
                    remove(self.spark, f"{self.folder}/{r['name']}")
            forget_versions(self.spark, self.folder, self.state["version"] - 2)


_TAKEN = "run_id long, session_id string, snap_id long"


def taken_by_runs(snapshots: DataFrame, run_log: DataFrame, depth: int = 3) -> DataFrame:
    """What each successful run takes: (run_id, session_id, snap_id).

    A run sees the rows with ``arrived_at <= cutoff_at``; it takes a session whose newest stamp is newer
    than the one the last successful run saw, or that run saw none. ``snap_id`` is the least among the seen
    rows with that stamp. Rows without session, arrival or any usable stamp do not count; other columns are
    ignored; repeated rows change nothing; no runs or no rows give no rows.

    The stamps are read once and folded, map-side, to one row per (session, first run that sees it), so a
    session with a third of all rows moves as one row per run. Then the runs follow one another over a new
    :class:`ChangeFeed`, each reading just what arrived since the one before and the saved states of the leaves
    that this touches.
    """
    spark = snapshots.sparkSession
    runs = successful_runs(run_log)
    if not runs:
        return spark.createDataFrame([], _TAKEN)
    cutoffs = F.array(*[F.lit(c) for _, c in runs])
    arrived = F.unix_micros(F.col("arrived_at").cast("timestamp"))
    facts = (
        snapshots.where("session_id is not null and arrived_at is not null and snap_id is not null")
        .select("session_id", F.col("snap_id").cast("long").alias("snap_id"), snapshot_stamp().alias("stamp"), F.size(F.filter(cutoffs, lambda c: c < arrived)).alias("run"))
        .where(F.col("stamp").isNotNull() & (F.col("run") < len(runs)))
        .groupBy("session_id", "run")
        .agg(F.max(F.struct(F.col("stamp"), (-F.col("snap_id")).alias("least"))).alias("m"))
        .select("run", F.col("session_id").alias("key"), F.col("m.stamp").alias("stamp"), (-F.col("m.least")).alias("snap"))
    )
    path = scratch(spark, "arrivals")
    facts.write.partitionBy("run").option("compression", "zstd").parquet(path)
    feed = ChangeFeed(spark, scratch(spark, "change-feed"), depth)
    for number, (run_id, cutoff) in enumerate(runs):
        if exists(spark, f"{path}/run={number}"):  # a run before which nothing arrived takes nothing
            feed.run(spark.read.schema("key string, stamp long, snap long").parquet(f"{path}/run={number}"), cutoff, run_id=run_id, folded=True)
    return feed.outputs().select("run_id", F.col("key").alias("session_id"), F.col("snap").alias("snap_id"))
