"""The versioned store, and the streams that keep their state in it."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from leadloom.operators.graph import graph_nodes, state_changes
from leadloom.operators.leads import apply_status
from leadloom.schemas import LEAD_STORE
from leadloom.session import scratch_path
from leadloom.sources.versioned import VersionedStore
from leadloom.streaming import graph, leads, runs
from test_streaming import write_files

AT = datetime(2026, 1, 1)


def lead_rows(spark, names):
    return spark.createDataFrame([(f"{n}@x.test", "C", "F", "r", False, False, AT) for n in names], LEAD_STORE)


def files_of(df):
    return {f.split("/data/")[1].split("/part")[0] for f in df.select(F.input_file_name().alias("f")).toPandas().f}


def test_an_update_rewrites_its_buckets_only(spark):
    store = VersionedStore(spark, scratch_path(spark, "store"), LEAD_STORE, "email", 16)
    assert store.latest() is None and store.snapshot().count() == 0
    assert store.update(lead_rows(spark, range(200)), lambda old, new: new) == 0
    before = files_of(store.snapshot())
    updates = spark.createDataFrame([("3@x.test", "contacted"), ("4@x.test", "failed"), ("none@x.test", "failed")], "email string, status string")
    assert store.update(updates, apply_status) == 1
    after = files_of(store.snapshot())
    assert 1 <= len(after - before) <= 3 and len(after) == len(before)  # the others are the files of before
    now = {r.email: (r.contacted, r.delivery_failed) for r in store.snapshot().collect()}
    assert len(now) == 200 and now["3@x.test"] == (True, False) and now["4@x.test"] == (True, True)
    assert sum(c for c, _ in now.values()) == 2
    old = store.snapshot(0)  # stays as it was
    assert old.count() == 200 and old.where("contacted").isEmpty()
    assert store.update(updates, apply_status, version=1) == 1 and store.versions() == [0, 1]  # a repeated batch
    assert store.update(updates.where("false"), apply_status) == 2 and store.snapshot().count() == 200
    store.forget([])
    assert store.versions() == [2] and store.snapshot().count() == 200 and files_of(store.snapshot()) == after


def test_rows_may_go(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    store = VersionedStore(spark, scratch_path(spark, "store"), schema, "k", 4)
    store.update(spark.range(20).select(F.col("id").alias("k"), F.col("id").alias("v")), lambda old, new: new)
    store.update(spark.range(20).select(F.col("id").alias("k")), lambda old, new: old.join(new, "k", "left_anti"))
    assert store.snapshot().count() == 0 and store.snapshot(0).count() == 20
    with pytest.raises(ValueError):
        VersionedStore(spark, "x", schema, "k", 0)


def test_lead_sink_over_ten_batches(spark, tmp_path):
    batches = [[(f"l{(7 * p + i) % 40}@x.test", f"p{p}", "F", "r", AT, p * 100 + i) for i in range(12)] for p in range(10)]
    batches[4].append((None, "no address", "F", "r", AT, 999))
    path = write_files(spark, tmp_path, batches, "email string, company_name string, founder_name string, reason string, date_found timestamp, i long")
    known = lead_rows(spark, ["known"]).unionByName(spark.createDataFrame([("l3@x.test", "old", "F", "r", True, False, AT)], LEAD_STORE))
    out = leads.lead_sink(runs.read_stream(spark, path, max_files=1), ["date_found", "i"], initial=known, buckets=8)
    rows = {r.email: r.company_name for r in out.collect()}
    assert out.count() == len(rows) == 41 and rows["l3@x.test"] == "old" and rows["known@x.test"] == "C"
    files = [f for f in out.inputFiles()]
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 8 and len(files) <= 8  # compact: one file per bucket


def test_live_nodes_drop_repeats(spark, tmp_path):
    rng = random.Random(6)
    events = [(n, f"https://n{rng.choice([0, 0, 0, 1, 2, 3])}.test/x", rng.choice(["pending", "convert"]), rng.choice(["a", None])) for n in range(120)]
    batches = [events[k:k + 15] for k in range(0, 120, 15)]
    path = str(tmp_path / "in.parquet")
    schema = "seq long, node_id string, state string, title string"
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    got = sorted(map(tuple, graph.live_nodes(runs.read_stream(spark, path, max_files=1), buckets=4).collect()))
    every = spark.createDataFrame(events, schema)
    wanted = sorted(map(tuple, graph_nodes(state_changes(every)).collect()))
    assert got == wanted and sum(r[-1] for r in got) < 120
