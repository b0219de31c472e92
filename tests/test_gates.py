"""Gates on streams, cut into batches, against the gates on tables."""

import numpy as np
import pytest

from sightline.streaming.gates import STORE, period_end_ms, stream_cost_gate, stream_quota_guard
from sightline.streaming.rate_limit import cost_gate

DAY = 86_400_000
START = 1_704_000_000_000  # 2023-12-31 05:20 UTC: the first requests cross a day, a month and a year


@pytest.fixture(scope="module")
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def streamed(spark, tmp_path, rows, schema, cuts, gate):
    """The gate's rows for a stream that gets these rows in batches; a batch is a file."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        if b > a:
            part = spark.createDataFrame(rows[a:b], schema).coalesce(1)
            part.write.mode("append").parquet(str(folder))
            # files are read in the order of their times
            import os
            import time

            newest = max((p for p in folder.glob("part-*")), key=lambda p: p.stat().st_ctime)
            os.utime(newest, (time.time() + 10 * i - 10_000,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = gate(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out))
    assert q.awaitTermination(300)
    return spark.read.parquet(str(out)).collect(), len(q.recentProgress)


def requests(n, seed):
    rng = np.random.default_rng(seed)
    at = np.sort(START + rng.integers(0, 40 * DAY, n)) // 1000 * 1000
    return [(str(k), i, int(t), ["free", "pro", None, "basic"][k % 4]) for i, (k, t) in enumerate(zip(rng.integers(0, 5, n), at, strict=True))]


@pytest.mark.parametrize("cuts", [[], [7, 8, 150], [100, 200]])
def test_cost_gate_of_a_stream_equals_that_of_a_table(spark, store, tmp_path, cuts):
    rows, schema = requests(300, 1), "key string, event_id long, at_ms long, plan string"
    got, _ = streamed(spark, tmp_path, rows, schema, cuts, lambda s: stream_cost_gate(s, 1, 12, 3 * 3_600_000))
    want = cost_gate(spark.createDataFrame(rows, schema), 1, 12, 3 * 3_600_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r["reason"] for r in got} == {"granted", "cache_hit", "daily_quota_exceeded", "monthly_quota_exceeded"}


def test_cost_gate_with_timers(spark, store, tmp_path):
    rows, schema = requests(200, 2), "key string, event_id long, at_ms long, plan string"
    got, _ = streamed(spark, tmp_path, rows, schema, [60, 120], lambda s: stream_cost_gate(s, 1, 12, 3_600_000, late="1 hour"))
    want = cost_gate(spark.createDataFrame(rows, schema), 1, 12, 3_600_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("cuts", [[], [50, 51, 90]])
def test_quota_guard_of_a_stream(spark, store, tmp_path, cuts):
    rng = np.random.default_rng(3)
    at = np.sort(START + rng.integers(0, 4 * DAY, 120))
    rows = [("abc"[i % 3], i, int(t), int(rng.integers(1, 4))) for i, t in enumerate(at)]
    budgets = spark.createDataFrame([("a", 12, 3), ("b", -1, 0)], "channel string, budget int, used int")
    got, _ = streamed(spark, tmp_path, rows, "channel string, event_id long, at_ms long, units int", cuts, lambda s: stream_quota_guard(s, budgets))
    used, want = {}, {}
    for c, e, t, units in rows:
        day = t // DAY
        free = {"a": 9, "b": 0}.get(c)
        fits = free is None or used.get((c, day), 0) + units <= free
        if fits:
            used[c, day] = used.get((c, day), 0) + units
        want[e] = (fits, None if free is None else free - used.get((c, day), 0))
    assert {r["event_id"]: (r["allowed"], r["left"]) for r in got} == want
    assert {x for x, _ in want.values()} == {True, False}


def test_ends_of_periods():
    assert period_end_ms("2023-12-31") == period_end_ms("2023-12") == 1_704_067_200_000
    assert period_end_ms("2024-02") - period_end_ms("2024-01") == 29 * DAY
