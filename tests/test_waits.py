import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from talweg.streaming import events, waits

SECOND, DAY, ZERO = 1000, 86_400_000, dt.datetime(2024, 1, 1)
WAIT = {"n": 3, "grace": 20 * SECOND, "limit": 120 * SECOND, "horizon": DAY}


def told(rows, until):
    """What a wait that sees all answers in order would tell."""
    questions = {}
    for user, ms in rows:
        if user is not None and ms is not None:
            questions.setdefault((user, ms // DAY), []).append(ms)
    out = []
    for (user, day), answers in questions.items():
        clock, got, quorum_at, why = day * DAY, 0, None, None
        for ms in sorted(answers):
            if ms > min(day * DAY + WAIT["limit"], DAY**2 if quorum_at is None else quorum_at + WAIT["grace"]):
                break
            got += 1
            if got == 2:
                quorum_at = ms
            if got == 3:
                why, clock = "all", ms
                break
        if why is None and quorum_at is not None and quorum_at + WAIT["grace"] <= day * DAY + WAIT["limit"]:
            why, clock = "quorum", quorum_at + WAIT["grace"]
        elif why is None:
            why, clock = "time", day * DAY + WAIT["limit"]
        if clock < until:
            out.append((user, day, why, got, clock - day * DAY))
    return sorted(out)


def run(spark, source, state):
    schema = "user_id long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("asked", F.date_trunc("day", "ts"))
    ended = waits.quorum_waits(stream, ["user_id"], "asked", "ts", delay="60 seconds", **WAIT)
    return sorted((r.user_id, (r.asked - ZERO).days, r.ended_by, r.answers, r.waited) for r in events.drained(ended, "waits", state).collect())


def put(spark, rows, source):
    as_rows = [(u, None if ms is None else ZERO + dt.timedelta(milliseconds=ms)) for u, ms in rows]
    spark.createDataFrame(as_rows, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)


def test_waits_out_of_order_and_over_a_restart(spark, tmp_path):
    """Files in turn, answers up to 50 seconds late, a restart in the middle: as if all had come in order."""
    rng = random.Random(5)
    rows = [(rng.randrange(12), day * DAY + rng.choice([0, rng.randrange(150_000), rng.randrange(40_000), 120_000])) for day in range(6) for _ in range(40)]
    rows += [(3, DAY), (3, DAY), (3, DAY + 20_000), (5, 2 * DAY + 1000), (5, 2 * DAY + 100_000), (5, 2 * DAY + 120_000)]
    rows.sort(key=lambda r: r[1] + rng.randrange(50_000))
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    cuts = [0, 70, 130, 200, len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for part in parts[:2]:
        put(spark, [*part, (None, 5), (1, None)], source)
    first = run(spark, source, state)
    seen = max(ms for part in parts[:2] for _, ms in part)
    assert first == told([r for p in parts[:2] for r in p], seen - 60_000)
    for part in parts[2:]:
        put(spark, part, source)
    last = run(spark, source, state)
    assert last == told(rows, max(ms for _, ms in rows) - 60_000) and len(last) > len(first)
    assert {r[2] for r in last} == {"all", "quorum", "time"}


def test_an_empty_stream_and_a_limit_beyond_the_horizon(spark, tmp_path):
    put(spark, [], f"{tmp_path}/in")
    assert run(spark, f"{tmp_path}/in", f"file://{tmp_path}/state") == []
    with pytest.raises(ValueError):
        waits.quorum_waits(None, [], "a", "b", 3, 1, 2, 1, "1 second")


def asked(calls, most, budget):
    """The services of one cascade, one after the other."""
    left, tried = budget, 0
    for order, needs, valid in calls:
        if left < 5:
            return None, tried, "out of time", budget - left
        may = max(5, min(most, left))
        tried += 1
        if needs is not None and needs <= may:
            left -= needs
            if valid:
                return order, tried, "answered", budget - left
        else:
            left -= may
    return None, tried, "failed", budget - left


def test_cascades(spark):
    rng = random.Random(3)
    chains = {k: [(i, rng.choice([None, 1.0, 5.0, 17.0, 40.0, 41.0, 55.0]), rng.choice([True, False, False, None])) for i in range(rng.randrange(1, 6))] for k in range(200)}
    chains[None] = [(0, 3.0, True)]
    df = spark.createDataFrame([(k, *c, "x") for k, cs in chains.items() for c in cs], "key long, nth int, needs double, valid boolean, rest string")
    got = {r.key: (r.answered_by, r.attempts, r.outcome, r.seconds) for r in waits.cascades(df, ["key"], "nth", "needs", "valid", 40.0, 60.0).collect()}
    assert got == {k: asked(cs, 40.0, 60.0) for k, cs in chains.items()}
    assert {v[2] for v in got.values()} == {"answered", "failed", "out of time"}
    assert waits.cascades(df.where("false"), ["key"], "nth", "needs", "valid", 40.0, 60.0).count() == 0


def test_python_is_not_called_for_each_question(spark, tmp_path):
    """Thousands of questions of one day are waited for in a bounded number of groups, and told as they would be one by one."""
    rows = [(u, d * DAY + ms) for u in range(3000) for d, ms in ((0, u), (0, 1000 + u), (1, 119_000))] + [(0, 3 * DAY)]
    put(spark, rows, f"{tmp_path}/in")
    assert run(spark, f"{tmp_path}/in", f"file://{tmp_path}/state") == told(rows, 3 * DAY - 60_000)
    kept = spark.read.format("statestore").load(f"file://{tmp_path}/state/state")
    assert kept.count() <= 3 * waits.BUCKETS
