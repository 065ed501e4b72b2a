"""Immutable tables sorted by a 128-bit key inside hash prefixes, and how tasks search and merge them.

A *run* is a Parquet folder ``what=run/prefix=K``; inside a prefix the rows ascend by (h1, h2). Row groups are
small, and their bounds stand in the files' footers, so a lookup is a binary search over row groups and then
inside those few that can hold a wanted key. The prefix of a key is the top bits of h1: it stays the same
however many runs there are and whoever reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.storage import arrow_filesystem

#: Bytes of a row group, which is what a lookup or a merge holds of a run at a time.
ROW_GROUP = 4 << 20


def prefix_of(h1: str | Column, bits: int) -> Column:
    """The hash prefix of a key: its top ``bits`` bits."""
    return (F.shiftrightunsigned(h1, 64 - bits) if bits else F.lit(0)).cast("int")


def write_run(df: DataFrame, path: str) -> None:
    """Writes rows of (what, prefix, h1, h2, ...) as a run; rows of other ``what`` come out beside it."""
    ordered = df.sortWithinPartitions("what", "prefix", "h1", "h2")
    ordered.write.mode("overwrite").partitionBy("what", "prefix").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def search(keys1: np.ndarray, keys2: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Places of (h1, h2) among sorted keys, -1 where absent."""
    n = len(keys1)
    at = np.searchsorted(keys1, h1)
    found = np.full(len(h1), -1, np.int64)
    open_ = np.flatnonzero(at < n)
    while len(open_):
        open_ = open_[keys1[at[open_]] == h1[open_]]
        hit = keys2[at[open_]] == h2[open_]
        found[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit]
        at[open_] += 1
        open_ = open_[at[open_] < n]
    return found


class PrefixReader:
    """One prefix of one run: its row groups with their bounds; only groups that can hold a wanted key are read."""

    def __init__(self, run: str, prefix: int, columns: list[str]):
        import pyarrow.parquet as pq
        from pyarrow import fs as arrow_fs

        self.columns, self.groups, self.bytes_read = ["h1", "h2", *columns], [], 0
        self._held: tuple[int, dict] | None = None
        fs, root = arrow_filesystem(f"{run}/what=run/prefix={prefix}")
        for info in sorted(fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
            if not info.is_file or not info.base_name.endswith(".parquet"):
                continue
            file = pq.ParquetFile(fs.open_input_file(info.path))
            place = file.schema_arrow.names.index("h1")
            for g in range(file.metadata.num_row_groups):
                group = file.metadata.row_group(g)
                if group.num_rows:
                    bounds = group.column(place).statistics
                    self.groups.append((bounds.min, bounds.max, file, g, group.total_byte_size))
        self.groups.sort(key=lambda x: x[:2])

    def group(self, k: int) -> dict:
        """Row group ``k`` as arrays by column (texts as Arrow arrays); the last one read is kept."""
        if self._held is None or self._held[0] != k:
            _, _, file, g, size = self.groups[k]
            table = file.read_row_group(g, columns=self.columns).combine_chunks()
            self.bytes_read += size
            text = lambda c: str(table.schema.field(c).type) in ("string", "large_string")
            self._held = (k, {c: table[c].combine_chunks() if text(c) else table[c].to_numpy() for c in self.columns})
        return self._held[1]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[tuple[np.ndarray, dict, np.ndarray]]:
        """For ascending ``h1``: (which of the wanted keys, a row group's columns, the places in it)."""
        for k, (low, high, *_) in enumerate(self.groups):
            a, b = np.searchsorted(h1, low), np.searchsorted(h1, high, "right")
            if a < b:
                cols = self.group(k)
                place = search(cols["h1"], cols["h2"], h1[a:b], h2[a:b])
                hit = np.flatnonzero(place >= 0)
                if len(hit):
                    yield a + hit, cols, place[hit]


def newest_first(readers: list[PrefixReader], h1: np.ndarray, h2: np.ndarray) -> Iterator[tuple[np.ndarray, dict, np.ndarray]]:
    """:meth:`PrefixReader.find` over runs, the newest first; a key is looked for no further once a run has it."""
    pending = np.arange(len(h1))
    for reader in readers:
        if not len(pending):
            return
        seen = np.zeros(len(pending), bool)
        for which, cols, place in reader.find(h1[pending], h2[pending]):
            seen[which] = True
            yield pending[which], cols, place
        pending = pending[~seen]


def merge(readers: list[PrefixReader]) -> Iterator[dict]:
    """The newest row of every key, ascending, in pieces; ``readers`` from the newest to the oldest.

    At most one row group per run is held: all keys up to the least upper bound of the groups at hand are merged
    and leave before the next group is read.
    """
    places, held = [0] * len(readers), [None] * len(readers)
    while True:
        for r, reader in enumerate(readers):
            while (held[r] is None or not len(held[r]["h1"])) and places[r] < len(reader.groups):
                held[r] = dict(reader.group(places[r]))
                places[r] += 1
        live = [r for r in range(len(readers)) if held[r] is not None and len(held[r]["h1"])]
        if not live:
            return
        # A key may run on into a run's next group, so only keys below the bound are complete where one follows.
        bound = min((held[r]["h1"][-1] for r in live if places[r] < len(readers[r].groups)), default=None)
        out, age = [], []
        for r in live:
            cut = len(held[r]["h1"]) if bound is None else int(np.searchsorted(held[r]["h1"], bound))
            if cut:
                out.append({c: v[:cut] for c, v in held[r].items()})
                age.append(np.full(cut, r))
            held[r] = {c: v[cut:] for c, v in held[r].items()}
        if not out:  # groups that begin with the bound: hold the next group of those that end with it as well
            for r in live:
                if places[r] < len(readers[r].groups) and held[r]["h1"][-1] == bound:
                    more = readers[r].group(places[r])
                    places[r] += 1
                    held[r] = {c: _join([v, more[c]]) for c, v in held[r].items()}
            continue
        cols = {c: _join([o[c] for o in out]) for c in out[0]}
        order = np.lexsort((np.concatenate(age), cols["h2"], cols["h1"]))
        a, b = cols["h1"][order], cols["h2"][order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        keep = order[first]
        yield {c: v[keep] if isinstance(v, np.ndarray) else v.take(_places(keep)) for c, v in cols.items()}


def _join(parts: list):
    if isinstance(parts[0], np.ndarray):
        return np.concatenate(parts)
    import pyarrow as pa

    return pa.concat_arrays(parts)


def _places(at: np.ndarray):
    import pyarrow as pa

    return pa.array(at)


def merged(runs: list[str], columns: list[str], schema: str):
    """mapInArrow over rows of prefixes: the merged run of each; ``runs`` from the oldest to the newest."""
    names = [c.split()[0] for c in schema.split(", ")]

    def job(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                for cols in merge([PrefixReader(r, prefix, columns) for r in reversed(runs)]):
                    n = len(cols["h1"])
                    fixed = {"what": pa.array(["run"] * n, pa.string()), "prefix": pa.array(np.full(n, prefix, np.int32))}
                    yield pa.RecordBatch.from_arrays([fixed[c] if c in fixed else pa.array(cols[c]) for c in names], names=names)

    return job


def due(runs: list[dict], merge_every: int) -> int:
    """How many of the newest runs make up a full level and are to be merged; 0 if none.

    Runs have levels; ``merge_every`` runs of one level become one of the next, so an entry is rewritten once a
    level, and the number of runs grows with the logarithm of the number of batches.
    """
    same = 0
    for run in reversed(runs):
        if run["level"] != runs[-1]["level"]:
            break
        same += 1
    return same if same >= merge_every else 0
