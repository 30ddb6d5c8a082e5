"""An extension: the session rule of events over a stream, with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import GAP_S, MOVE_GAP_S


def closed_sessions(stream: DataFrame, key: str, late: str = "1 hour", gap: float = GAP_S, move_gap: float = MOVE_GAP_S) -> DataFrame:
    """(key, start_at, end_at, items) of sessions that are over, from (key, ts, city) rows.

    Rows may come late by ``late``: they wait in the state until the watermark has passed them, so
    sessions are those of the batch operator. What a key holds is bounded by the rows of a gap and
    the allowed lateness. Later rows are dropped, as watermarks do.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, start, end, items, city = state.get if state.exists else ("[]", None, None, 0, None)
        rows = pd.read_json(waiting, orient="values", dtype=False) if waiting != "[]" else pd.DataFrame(columns=[0, 1])
        held = [(float(t), None if c is None or c != c else str(c)) for t, c in rows.itertuples(index=False)]
        for b in batches:
            held += [(t.timestamp(), None if c is None or c != c else c) for t, c in zip(b["ts"], b["city"])]
        mark = state.getCurrentWatermarkMs() / 1000
        held.sort(key=lambda r: (r[0], r[1] or ""))
        out = []

        def close() -> None:
            out.append((keys[0], start, end, items))

        left = []
        for t, c in held:
            if t > mark and not state.hasTimedOut:
                left.append((t, c))
                continue
            pause = None if end is None else t - end
            if pause is not None and (pause > gap or pause > move_gap and c is not None and city is not None and c != city):
                close()
                start, items = None, 0
            start, end, items, city = t if start is None else start, t, items + 1, c if c is not None else city
        if end is not None and items and mark > end + gap and not left:
            close()
            state.remove()
        else:
            state.update((pd.DataFrame(left).to_json(orient="values") if left else "[]", start, end, items, city))
            state.setTimeoutTimestamp(int(max(mark, (min(t for t, _ in left) if left else end or 0) + (0 if left else gap)) * 1000) + 1)
        yield pd.DataFrame(out, columns=[key, "start_at", "end_at", "items"])

    kind = dict(stream.dtypes)[key]
    marked = stream.select(key, "ts", "city").withWatermark("ts", late)
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start_at double, end_at double, items long", "waiting string, start double, end double, items long, city string", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, kind, items) of an event stream in tumbling days, with late rows dropped after ``late``."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("items")).select(F.col("w.start").alias("day"), "kind", "items")
