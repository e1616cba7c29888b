"""Sliced computations, delivery outcomes and schedules against plain Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadloom.operators import outreach as O, slices


def hot_rows(n=600):
    rng = random.Random(3)
    return [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.randint(0, 9)) for i in range(n)]


def test_running_total_and_numbers(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = {r.pos: r.t for r in slices.running_total(df, "v", ["pos"], "pos", "t", ["k"], pieces=7).collect()}
    sums = defaultdict(int)
    for k, pos, v in rows:
        assert got[pos] == sums[k]
        sums[k] += v
    numbered = slices.number_rows(df.orderBy(F.rand(1)), ["pos"], "pos", "n", pieces=5)
    assert sorted((r.pos, r.n) for r in numbered.collect()) == [(i, i + 1) for i in range(len(rows))]
    assert slices.number_rows(df.limit(0), ["pos"], "pos", "n").isEmpty()


def test_slices_cut_a_hot_key(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"))
    bounds = slices.slice_bounds(df, "pos", 10)
    sizes = df.groupBy(slices._slice_of(F.col("pos"), bounds)).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) <= 120


def test_slices_of_many_borders(spark):
    from bisect import bisect_right

    rng = random.Random(5)
    for borders in ([], [3], [1, 5, 9], sorted({rng.randint(0, 10**12) for _ in range(4000)}), [0.5, 1.25, 2.0], [-3, 0, 2**60 + 1]):
        values = [rng.choice([*borders, 0]) + rng.choice([-1, 0, 1]) for _ in range(300)]
        kind = "double" if any(isinstance(b, float) for b in borders) else "long"
        df = spark.createDataFrame([(float(v) if kind == "double" else v,) for v in values], f"v {kind}")
        got = df.select("v", slices._slice_of(F.col("v"), borders).alias("s")).collect()
        assert all(r.s == bisect_right(borders, r.v) for r in got)


def test_previous_value(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = {r.pos: r.p for r in slices.previous_value(df, F.when(F.col("v") > 2, F.col("v")), ["pos"], "pos", "p", ["k"],
                                                     pieces=9).collect()}
    last = {}
    for k, pos, v in rows:
        assert got[pos] == last.get(k)
        last[k] = v if v > 2 else None


def by_hand(attempts, max_retries=1):
    """One lead after another, the way a worker would do it."""
    retries, last_soft = 0, None
    for ts, outcome in attempts:
        if outcome == "ok":
            return "contacted", retries, ts, None
        if outcome == "hard_bounce":
            return "dead", retries, ts, None
        if retries < max_retries:
            retries, last_soft = retries + 1, ts
        else:
            return "dead", retries, ts, None
    return "retry", retries, None, last_soft + timedelta(seconds=60)


def test_delivery_outcome(spark):
    rng, start = random.Random(5), datetime(2026, 1, 1)
    for max_retries in (0, 1, 2):
        attempts = {f"m{i}@x.test": [(start + timedelta(minutes=j), rng.choice(["ok", "soft_fail", "soft_fail", "hard_bounce"]))
                                     for j in range(rng.randint(1, 5))] for i in range(60)}
        attempts["retry@x.test"] = [(start, "soft_fail")] if max_retries else [(start, "ok")]
        rows = [(m, ts, j, o) for m, a in attempts.items() for j, (ts, o) in enumerate(a)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "email string, ts timestamp_ntz, event_id long, outcome string")
        got = {r.email: (r.state, r.retry_count, r.decided_at, r.retry_at)
               for r in O.delivery_outcome(df, max_retries).collect()}
        assert got == {m: by_hand(a, max_retries) for m, a in attempts.items()}


def test_gaps_and_schedule(spark):
    rows = [(f"l{i}@x.test", "s" if i % 3 else "t", datetime(2026, 1, 1 + i % 5)) for i in range(300)]
    rows.append(("NEEDS_ENRICHMENT@x.com", "s", datetime(2026, 1, 1)))
    df = spark.createDataFrame(rows, "email string, sender string, date_found timestamp")
    plan = O.send_schedule(df, interval_sec=100).collect()
    assert len(plan) == 300 and all(80 <= r.gap_sec <= 120 for r in plan)
    for sender in ("s", "t"):
        mine = sorted((r for r in plan if r.sender == sender), key=lambda r: r.send_offset_sec)
        assert [r.date_found for r in mine] == sorted(r.date_found for r in mine)
        assert all(b.send_offset_sec - a.send_offset_sec == a.gap_sec for a, b in zip(mine, mine[1:]))
        assert mine[0].send_offset_sec == 0


def test_fallback(spark):
    store = spark.createDataFrame([(f"p{i}@x.test", "c", "f", i % 2 == 0) for i in range(40)],
                                  "email string, company_name string, founder_name string, contacted boolean")
    dead = spark.createDataFrame([(f"d{i}@x.test",) for i in range(25)], "email string")
    rows = O.fallback_leads(dead, store).collect()
    used = [r.email for r in rows if r.email]
    assert len(rows) == 25 and len(used) == len(set(used)) == 20
