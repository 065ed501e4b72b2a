"""Streams of events: the same detectors over what arrives, and sequences with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, delay: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Hits per detector and session window; late events count until the watermark has passed.

    ``stream``: ts timestamp, session_id string, detector string.
    """
    window = F.session_window("ts", gap)
    return stream.withWatermark("ts", delay).groupBy(window, "session_id", "detector").agg(F.count("*").alias("hits")).select("session_id", "detector", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "hits")


_FOLLOWED = "session_id string, pos long, followed boolean"
_STATE = "pos array<long>, left array<int>"


def order_within_stream(stream: DataFrame, within: int, idle: str = "2 hours") -> DataFrame:
    """(session_id, pos, followed) for every opener, as soon as it is decided: the streaming form of ``order``.

    ``stream``: ts, session_id, pos, first boolean, then boolean, step boolean, ordered within a session as
    it arrives. The state of a session is its undecided openers with the steps that they have left, at most
    ``within`` steps' worth; a session whose last event is older than the watermark by ``idle`` closes them
    as not followed. Time is that of the events, so a replay gives the same rows.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    idle_ms = _milliseconds(idle)

    def update(key, frames: Iterator, state):
        import pandas as pd

        pos, left = (list(x) for x in state.get) if state.exists else ([], [])
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]] * len(pos), "pos": pos, "followed": [False] * len(pos)})
            return
        latest = 0
        for frame in frames:
            latest = max(latest, int(frame["ts"].max().timestamp() * 1000))
            for row in frame.sort_values("pos").itertuples():
                if row.then:
                    out += [(key[0], p, True) for p in pos]
                    pos, left = [], []
                if row.step:
                    left = [n - 1 for n in left]
                    out += [(key[0], p, False) for p, n in zip(pos, left) if n <= 0]
                    pos, left = [p for p, n in zip(pos, left) if n > 0], [n for n in left if n > 0]
                if row.first:
                    pos.append(row.pos)
                    left.append(within)
        state.update((pos, left))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "pos", "followed"])

    return stream.withWatermark("ts", "10 minutes").groupBy("session_id").applyInPandasWithState(update, _FOLLOWED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
