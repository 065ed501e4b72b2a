"""Deeply nested records turned into flat tables that keep their parents.

Both operators read JSON through the structural index of :mod:`logloom.functions.jsontape`; whole Arrow
batches are indexed at once and only the few spans that go into the result are decoded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.jsontape import CLOSE_ARR, CLOSE_OBJ, OPEN_ARR, OPEN_OBJ, SCALAR, STRING, Tape, arrow_bytes, index

ITEMS = "src string, row_id long, msg_no long, item_kind string, item_no long, item_id string, command string"


def _text(value) -> str:
    """A leaf as text: '' for none, lists joined by single blanks, other values as JSON spells them."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return " ".join(map(_text, value))
    return json.dumps(value, ensure_ascii=False)


class _View:
    """Lookups on a tape by parent: the child under a name, the items of a value."""

    def __init__(self, tape: Tape):
        self.tape = tape
        self._by: dict[str, np.ndarray] = {}
        self._null = {}

    def child(self, parents: np.ndarray, name: str) -> np.ndarray:
        """For each object token its value under ``name``, or -1; null values count as absent."""
        if name not in self._by:
            t = self.tape
            at = t.keyed(name)
            null = (t.kind[at] == SCALAR) & (t.end[at] - t.start[at] == 4)
            null[null] = t.data[t.start[at[null]]] == ord("n")
            at = at[~null]
            table = np.full(len(t.kind) + 1, -1, np.int64)
            table[t.parent[at]] = at
            table[-1] = -1
            self._by[name] = table
        return self._by[name][parents]

    def items(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Objects that ``values`` hold: (position of the value in ``values``, token). An object stands for itself."""
        t = self.tape
        owner = np.full(len(t.kind) + 1, -1, np.int64)
        arrays = np.flatnonzero((values >= 0) & (t.kind[values] == OPEN_ARR))
        owner[values[arrays]] = arrays
        objs = np.flatnonzero(t.kind == OPEN_OBJ)
        own = owner[t.parent[objs]]  # parent -1 reads the spare last cell
        inner = own >= 0
        single = np.flatnonzero((values >= 0) & (t.kind[values] == OPEN_OBJ))
        return np.concatenate([own[inner], single]), np.concatenate([objs[inner], values[single]])

    def place(self, values: np.ndarray, owners: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The item's place in its array; 0 for an object that stands alone."""
        return np.where(values[owners] == items, 0, self.tape.place[items])


def _leaf(tape: Tape, i: int) -> str:
    if i < 0:
        return ""
    return tape.string(i) if tape.kind[i] == STRING else _text(tape.load(i))


def _command(tape: Tape, args: int, command: int) -> str:
    """``command`` of an arguments value; arguments spelled as JSON text are read as what they spell."""
    if args < 0:
        return ""
    if tape.kind[args] == OPEN_OBJ:
        return _leaf(tape, command)
    if tape.kind[args] == STRING:
        try:
            spelled = json.loads(tape.string(args))
        except ValueError:
            return ""
        return _text(spelled.get("command")) if isinstance(spelled, dict) else ""
    return ""


def _roots(tape: Tape) -> np.ndarray:
    at = np.flatnonzero((tape.kind == OPEN_OBJ) & (tape.parent < 0))
    return at[tape.readable[tape.text[at]]]


def content_blocks(tape: Tape) -> list[tuple]:
    """tool_use and tool_result blocks standing directly in ``content``: (text, msg_no, kind, place, id, command)."""
    v = _View(tape)
    content = v.child(_roots(tape), "content")
    owners, items = v.items(content)
    if not len(items):
        return []
    places, kinds = v.place(content, owners, items), v.child(items, "type")
    ids, of, inputs = v.child(items, "id"), v.child(items, "tool_use_id"), v.child(items, "input")
    commands = v.child(inputs, "command")
    rows = []
    for j in np.flatnonzero((kinds >= 0) & (tape.kind[kinds] == STRING)):
        kind = tape.string(kinds[j])
        if kind == "tool_use":
            rows.append((tape.text[items[j]], -1, kind, places[j], _leaf(tape, ids[j]), _command(tape, inputs[j], commands[j])))
        elif kind == "tool_result":
            rows.append((tape.text[items[j]], -1, kind, places[j], _leaf(tape, of[j]), ""))
    return rows


def calls_and_responses(tape: Tape) -> list[tuple]:
    """toolCalls and functionResponse parts of a record, or of each of its ``messages``: as :func:`content_blocks`."""
    v = _View(tape)
    roots = _roots(tape)
    held = v.child(roots, "messages")
    owners, inner = v.items(held)
    holders = np.concatenate([roots, inner])
    numbers = np.concatenate([np.full(len(roots), -1, np.int64), v.place(held, owners, inner)])
    rows = []
    calls = v.child(holders, "toolCalls")
    own, items = v.items(calls)
    if len(items):
        places, ids, args = v.place(calls, own, items), v.child(items, "id"), v.child(items, "args")
        commands = v.child(args, "command")
        for j, o in enumerate(own):
            rows.append((tape.text[items[j]], numbers[o], "call", places[j], _leaf(tape, ids[j]), _command(tape, args[j], commands[j])))
    content = v.child(holders, "content")
    own, items = v.items(content)
    if len(items):
        places, responses = v.place(content, own, items), v.child(items, "functionResponse")
        ids = v.child(responses, "id")
        for j in np.flatnonzero(responses >= 0):
            rows.append((tape.text[items[j]], numbers[own[j]], "response", places[j], _leaf(tape, ids[j]), ""))
    return rows


def _reader(src: str, extract: Callable[[Tape], list[tuple]]):
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("msg_no", pa.int64()), ("item_kind", pa.string()), ("item_no", pa.int64()), ("item_id", pa.string()), ("command", pa.string())])
        for batch in batches:
            ids = batch.column(0)
            rows = extract(index(*arrow_bytes(batch.column(1))))
            text, msg_no, kind, place, item_id, command = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([src] * len(rows), pa.string()),
                    ids.take(pa.array(np.array(text, np.int64))).cast(pa.int64()),
                    pa.array(np.array(msg_no, np.int64)),
                    pa.array(kind, pa.string()),
                    pa.array(np.array(place, np.int64)),
                    pa.array(item_id, pa.string()),
                    pa.array(command, pa.string()),
                ],
                schema=schema,
            )

    return read


def tool_items(lines: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """Nested tool calls and results as flat rows that name their parent row.

    ``lines`` has ``line_id`` and ``message`` (blocks of ``message.content``), ``records`` ``record_id`` and
    ``body`` (toolCalls and functionResponse parts, also inside ``messages[]``); either may be absent and
    further columns are ignored. Every physical row counts. NULL, empty and unreadable texts give no rows;
    an absent or null id or command is ``''``; array elements that are no objects keep their place but give
    no row. No shuffle: a row's items depend on that row alone.
    """
    parts = []
    if lines is not None:
        parts.append(lines.select(F.col("line_id").cast("long"), "message").where("message is not null").mapInArrow(_reader("session_lines", content_blocks), ITEMS))
    if records is not None:
        parts.append(records.select(F.col("record_id").cast("long"), "body").where("body is not null").mapInArrow(_reader("chat_records", calls_and_responses), ITEMS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


NODES = "row_id long, node long, parent long, depth int, name string, place long, kind string, value string"


def node_table(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """Every value of every readable JSON text as one row: the general parent-child table.

    ``node`` numbers the values of a row in document order, ``parent`` is the node of the container (-1 at
    the root), ``name`` the key under which the value stands (NULL in arrays), ``place`` its place among its
    container's values, ``kind`` one of object, array, string, number, boolean, null, and ``value`` the text
    of a leaf (NULL for containers and null). Unreadable, empty and NULL texts give no rows.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = {OPEN_OBJ: "object", OPEN_ARR: "array", STRING: "string"}
        for batch in batches:
            t = index(*arrow_bytes(batch.column(1)))
            at = np.flatnonzero(t.value & t.readable[t.text])
            number = np.full(len(t.kind) + 1, -1, np.int64)
            first = np.searchsorted(t.text[at], t.text[at])
            number[at] = np.arange(len(at)) - first
            step = np.isin(t.kind, (OPEN_OBJ, OPEN_ARR)).astype(np.int64) - np.isin(t.kind, (CLOSE_OBJ, CLOSE_ARR))
            depth = np.cumsum(step) - step
            root = np.zeros(len(t.readable), np.int64)
            tops = at[t.parent[at] < 0]
            root[t.text[tops]] = depth[tops]
            kinds, values = [], []
            for i in at.tolist():
                kind = names.get(int(t.kind[i]))
                if kind is None:
                    raw = t.raw(i).decode()
                    kind = "null" if raw == "null" else "boolean" if raw in ("true", "false") else "number"
                    values.append(None if kind == "null" else raw)
                else:
                    values.append(t.string(i) if kind == "string" else None)
                kinds.append(kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(t.text[at])).cast(pa.int64()),
                    pa.array(number[at]),
                    pa.array(number[t.parent[at]]),
                    pa.array((depth[at] - root[t.text[at]]).astype(np.int32)),
                    pa.array([t.string(k) if k >= 0 else None for k in t.key[at].tolist()], pa.string()),
                    pa.array(t.place[at]),
                    pa.array(kinds, pa.string()),
                    pa.array(values, pa.string()),
                ],
                names=["row_id", "node", "parent", "depth", "name", "place", "kind", "value"],
            )

    return df.select(F.col(row_id).cast("long").alias("row_id"), F.col(column).alias("text")).where("text is not null").mapInArrow(read, NODES)
