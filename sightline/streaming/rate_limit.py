"""Fixed-window rate limiting and quota gates, batch and streaming.

A window starts with the first event of its key, so clock-aligned windows do
not give it; it is a fold over a key's events in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "key string, event_id long, at_ms long, allowed boolean, remaining int, retry_after_ms long"


def _fold(start: int | None, count: int, at: int, window_ms: int, most: int) -> tuple[int, int, bool, int, int]:
    """(window start, count, allowed, remaining, retry after) for one event."""
    if start is None or at - start >= window_ms:
        return at, 1, True, most - 1, 0
    if count >= most:
        return start, count, False, 0, window_ms - (at - start)
    return start, count + 1, True, most - count - 1, 0


def rate_limit(events: DataFrame, window_ms: int, most: int) -> DataFrame:
    """events: key, event_id, at_ms.  Each event with ``allowed``, ``remaining``
    and ``retry_after_ms``; ties in time go by event id.

    Keys are hashed to partitions and sorted there; the fold reads a partition
    as a stream and holds one key's window, so a hot key costs time, no memory."""
    if window_ms <= 0 or most <= 0:
        raise ValueError("window_ms and most must be positive")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count = None, None, 0
        for part in parts:
            out = []
            for k, e, at in zip(part["key"], part["event_id"], part["at_ms"], strict=True):
                if k != key:
                    key, start, count = k, None, 0
                start, count, ok, left, wait = _fold(start, count, at, window_ms, most)
                out.append((k, e, at, ok, left, wait))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    e = events.select(F.col("key").cast("string"), F.col("event_id").cast("long"), F.col("at_ms").cast("long"))
    return e.repartition("key").sortWithinPartitions("key", "at_ms", "event_id").mapInPandas(run, OUT)


def stream_rate_limit(events: DataFrame, window_ms: int, most: int, expire: bool = True) -> DataFrame:
    """The same fold on a stream: a key's window is its state, dropped when no
    event has come for a window.  Timers keep a stream busy, so one that is to
    end when its input does (availableNow) is run with expire=False.  Events of a batch are folded in time order;
    one that comes later than a batch counts when it comes."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["at_ms", "event_id"])
        out = []
        for e, at in zip(rows["event_id"], rows["at_ms"], strict=True):
            start, count, ok, left, wait = _fold(start, count, int(at), window_ms, most)
            out.append((key[0], e, at, ok, left, wait))
        state.update((start, count))
        if expire:
            state.setTimeoutDuration(window_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    e = events.select(F.col("key").cast("string"), F.col("event_id").cast("long"), F.col("at_ms").cast("long"))
    return e.groupBy("key").applyInPandasWithState(step, OUT, "start long, count int", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def event_trend(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream (or table) by clock-aligned window and type; an addition
    to what the metrics ask for.  events: at (timestamp), event_type."""
    return events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


#: How a plan multiplies the limits.
PLAN_FACTOR = {"free": 1, "basic": 2, "pro": 4, "business": 10}
GATE = "key string, event_id long, at_ms long, allowed boolean, reason string"


def cost_gate(requests: DataFrame, daily: int, monthly: int, cache_ms: int = 0) -> DataFrame:
    """requests: key (operation and subject), event_id, at_ms, plan.  A request is
    allowed within cache_ms of a grant, else while the key's UTC day and then its
    month are below their limits times the plan's factor."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, until, day, month, used_d, used_m = None, -1, None, None, 0, 0
        for part in parts:
            out = []
            when = pd.to_datetime(part["at_ms"], unit="ms")
            for k, e, at, plan, d, m in zip(part["key"], part["event_id"], part["at_ms"], part["plan"], when.dt.strftime("%Y-%m-%d"), when.dt.strftime("%Y-%m"), strict=True):
                if k != key:
                    key, until, day, month, used_d, used_m = k, -1, None, None, 0, 0
                if d != day:
                    day, used_d = d, 0
                if m != month:
                    month, used_m = m, 0
                factor = PLAN_FACTOR.get(plan, 1)
                if until > at:
                    out.append((k, e, at, True, "cache_hit"))
                elif used_d >= daily * factor:
                    out.append((k, e, at, False, "daily_quota_exceeded"))
                elif used_m >= monthly * factor:
                    out.append((k, e, at, False, "monthly_quota_exceeded"))
                else:
                    used_d, used_m, until = used_d + 1, used_m + 1, at + cache_ms if cache_ms > 0 else -1
                    out.append((k, e, at, True, "granted"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GATE.split(", ")])

    r = requests.select(F.col("key").cast("string"), F.col("event_id").cast("long"), F.col("at_ms").cast("long"), F.col("plan").cast("string"))
    return r.repartition("key").sortWithinPartitions("key", "at_ms", "event_id").mapInPandas(run, GATE)
