"""Cost and quota gates on streams: a key's use is state between batches.

Use is counted by UTC day and month in map state, so requests of two days may
stand in one batch.  With a watermark, what a past month (or day) used and a
grant that has run out are dropped by timers; without one, state stays and no
request is ever late.  State is kept in RocksDB: sessions set
``spark.sql.streaming.stateStore.providerClass`` to STORE."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .rate_limit import GATE, PLAN_FACTOR

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUOTA = "channel string, event_id long, at_ms long, units int, allowed boolean, left int"


def _times(at_ms: pd.Series) -> tuple[list[str], list[str]]:
    when = pd.to_datetime(at_ms, unit="ms")
    return when.dt.strftime("%Y-%m-%d").tolist(), when.dt.strftime("%Y-%m").tolist()


def period_end_ms(period: str) -> int:
    """The first millisecond after a day (YYYY-MM-DD) or a month (YYYY-MM)."""
    if len(period) > 7:
        end = datetime.fromisoformat(period).replace(tzinfo=UTC) + timedelta(days=1)
    else:
        year, month = map(int, period.split("-"))
        end = datetime(year + month // 12, month % 12 + 1, 1, tzinfo=UTC)
    return int(end.timestamp() * 1000)


class _Used(StatefulProcessor):
    """Counts of a key by period, and timers at the periods' ends."""

    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "period string", "n int")
        self.until = handle.getValueState("until", "at_ms long")

    def read(self, period: str, known: dict[str, int]) -> int:
        if period not in known:
            known[period] = self.used.getValue((period,))[0] if self.used.containsKey((period,)) else 0
        return known[period]

    def write(self, known: dict[str, int]) -> None:
        for period, n in known.items():
            self.used.updateValue((period,), (n,))
            if self.timers:
                self.handle.registerTimer(period_end_ms(period))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (period,) in list(self.used.keys()):
            if period_end_ms(period) <= now:
                self.used.removeKey((period,))
        if self.until.exists() and self.until.get()[0] <= now:
            self.until.clear()
        return iter([])


class _CostGate(_Used):
    def __init__(self, daily: int, monthly: int, cache_ms: int, timers: bool):
        super().__init__(timers)
        self.daily, self.monthly, self.cache_ms = daily, monthly, cache_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        until = self.until.get()[0] if self.until.exists() else -1
        known: dict[str, int] = {}
        out = []
        for e, at, plan, day, month in zip(x["event_id"], x["at_ms"], x["plan"], *_times(x["at_ms"]), strict=True):
            factor = PLAN_FACTOR.get(plan, 1)
            if until > at:
                reason = "cache_hit"
            elif self.read(day, known) >= self.daily * factor:
                reason = "daily_quota_exceeded"
            elif self.read(month, known) >= self.monthly * factor:
                reason = "monthly_quota_exceeded"
            else:
                reason = "granted"
                known[day], known[month] = known[day] + 1, known[month] + 1
                until = int(at) + self.cache_ms if self.cache_ms > 0 else -1
            out.append((key[0], e, at, reason in ("cache_hit", "granted"), reason))
        self.write(known)
        if until >= 0:
            self.until.update((until,))
            if self.timers:
                self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in GATE.split(", ")])


class _QuotaGuard(_Used):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        known: dict[str, int] = {}
        out = []
        for e, at, units, budget, spent, day in zip(x["event_id"], x["at_ms"], x["units"], x["budget"], x["spent"], _times(x["at_ms"])[0], strict=True):
            used = self.read(day, known)
            free = None if pd.isna(budget) else max(0, int(budget)) - max(0, int(spent)) - used
            ok = free is None or units <= free
            if ok:
                known[day] = used + int(units)
            out.append((key[0], e, at, units, ok, None if free is None else max(0, free - units * ok)))
        self.write(known)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in QUOTA.split(", ")]).astype({"left": "Int32"})


def _gate(x: DataFrame, key: str, processor: StatefulProcessor, out: str, late: str | None) -> DataFrame:
    if late:
        x = x.withWatermark("at", late)
    return x.groupBy(key).transformWithStateInPandas(processor, out, "append", "eventTime" if late else "none")


def _timed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("event_id").cast("long").alias("event_id"), F.col("at_ms").cast("long").alias("at_ms"), F.timestamp_millis("at_ms").alias("at"), *more)


def stream_cost_gate(requests: DataFrame, daily: int, monthly: int, cache_ms: int = 0, late: str | None = None) -> DataFrame:
    """``rate_limit.cost_gate`` on a stream of key, event_id, at_ms, plan.

    Requests of a batch are judged in time order, one that comes later than a
    batch when it comes; a stream cut anywhere in that order gives what the whole
    table gives.  late: how long state is kept past the newest request, and then
    a request older than that is dropped; without it nothing is dropped."""
    x = _timed(requests, F.col("key").cast("string").alias("key"), F.col("plan").cast("string").alias("plan"))
    return _gate(x, "key", _CostGate(daily, monthly, cache_ms, bool(late)), GATE, late)


def stream_quota_guard(requests: DataFrame, budgets: DataFrame, late: str | None = None) -> DataFrame:
    """requests: a stream of channel, event_id, at_ms, units.  budgets: channel,
    budget, used, a table.  ``allowed`` while a channel's units of the UTC day
    fit into what its budget has left, and what is ``left`` after the request; a
    channel without a budget has no bound.  A request that does not fit takes
    nothing, so a smaller one after it may fit.  Order and late as in
    ``stream_cost_gate``."""
    b = budgets.select(F.col("channel").cast("string").alias("channel"), F.col("budget").cast("int").alias("budget"), F.coalesce(F.col("used"), F.lit(0)).cast("int").alias("spent"))
    x = _timed(requests, F.col("channel").cast("string").alias("channel"), F.col("units").cast("int").alias("units"))
    return _gate(x.join(b, "channel", "left"), "channel", _QuotaGuard(bool(late)), QUOTA, late)
