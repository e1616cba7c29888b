from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadloom.streaming import delivery, leads, runs, urls


def write_files(spark, tmp_path, parts, schema):
    path = str(tmp_path / "in.parquet")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_each_url_once(spark, tmp_path):
    path = write_files(spark, tmp_path, [[(i, f"u{i % 3}") for i in range(30)], [(99, "u1"), (100, "new")]], "id long, url string")
    runs.use_rocksdb(spark)
    out = runs.run_append(urls.first_sight(runs.read_stream(spark, path, max_files=1), "id"), "t")
    assert sorted(r.url for r in out.collect()) == ["new", "u0", "u1", "u2"]


def test_no_lead_is_lost_or_doubled(spark, tmp_path):
    at = datetime(2026, 1, 1)
    batches = [[(f"p{p}l{i}@x.test", "C", "F", "r", at, p * 10 + i) for i in range(10)] for p in range(5)]
    batches.append([("p0l0@x.test", "late", "F", "r", at, 999)])
    path = write_files(spark, tmp_path, batches, "email string, company_name string, founder_name string, reason string, "
                                                 "date_found timestamp, i long")
    out = leads.lead_sink(runs.read_stream(spark, path, max_files=1), ["date_found", "i"])
    rows = out.collect()
    assert len(rows) == 50 and {r.company_name for r in rows} == {"C"}


def test_delivery_over_several_batches(spark, tmp_path):
    t = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    batches = [[("a", t(0), 0, "soft_fail"), ("b", t(0), 1, "hard_bounce"), ("c", t(0), 2, "soft_fail"), ("d", t(5), 3, "soft_fail")],
               [("a", t(1), 4, "ok"), ("b", t(1), 5, "ok"), ("c", t(1), 6, "soft_fail"), ("e", t(0), 7, "opened")]]
    path = write_files(spark, tmp_path, batches, "email string, ts timestamp, event_id long, outcome string")
    runs.use_rocksdb(spark)
    changes = runs.run_batches(delivery.delivery_states(runs.read_stream(spark, path, max_files=1)), "t", mode="update")
    got = {r.email: (r.state, r.retry_count) for r in delivery.current_states(changes).collect()}
    assert got == {"a": ("contacted", 1), "b": ("dead", 0), "c": ("dead", 1), "d": ("retry", 1)}


def test_live_stats(spark, tmp_path):
    path = write_files(spark, tmp_path, [[(True,), (False,)], [(False,)]], "contacted boolean")
    out = runs.last_batch(runs.run_batches(leads.live_stats(runs.read_stream(spark, path, max_files=1)), "t", mode="complete"))
    assert [tuple(r) for r in out.collect()] == [(3, 2)]


def due_by_hand(events, delay, max_retries, until):
    """Retries due until the watermark, from all attempts of each lead in order."""
    out = []
    for key in sorted({e[0] for e in events}):
        own = sorted((at, n, kind) for k, at, n, kind in events if k == key)
        soft = [(at, n) for at, n, kind in own if kind == "soft_fail"]
        ends = [(at, n) for at, n, kind in own if kind in ("ok", "hard_bounce")] + soft[max_retries:max_retries + 1]
        for i, (at, _) in enumerate(soft[:max_retries], 1):
            if at + delay <= until and not any(e[0] <= at + delay for e in ends):
                out.append((key, i, at, at + delay))
    return out


def test_retries_come_when_they_are_due(spark, tmp_path):
    import random

    rng = random.Random(7)
    start, minute = datetime(2026, 1, 1), timedelta(minutes=1)
    events = [(f"l{rng.randrange(25)}", start + timedelta(seconds=7 * n), n, rng.choice(["soft_fail", "soft_fail", "ok", "hard_bounce", "opened"]))
              for n in range(160)]
    batches = [events[k:k + 40] for k in range(0, 160, 40)] + [[("last", start + timedelta(hours=1), 999, "ok")]]
    runs.use_rocksdb(spark)
    for parts, retries in ((batches, 1), (batches, 2), ([[e for b in batches for e in b]], 1)):
        path = write_files(spark, tmp_path / f"{len(parts)}-{retries}", parts, "email string, ts timestamp, event_id long, outcome string")
        found = runs.run_append(delivery.retries_due(runs.read_stream(spark, path, max_files=1), max_retries=retries), "due")
        got = sorted((r.key, r.attempt, r.failed_at, r.due_at) for r in found.collect())
        assert got == due_by_hand([e for b in batches for e in b], minute, retries, start + timedelta(hours=1)) and got
