"""Streams give what the batch operators give on the same log."""

import pytest

from oncelog.operators import audit, breaker, effects
from oncelog.sources import tables
from oncelog.streaming import effects as streams


def run(spark, df, transform, tmp_path, name, files=3):
    source = str(tmp_path / name)
    df.repartition(files).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).collect()


def test_collapse(spark, sf, tmp_path):
    d = tables.deliveries(spark, sf).where("cast(key as long) < 120")
    got = run(spark, d.select("key", "delivery_no", "ts"), streams.collapse, tmp_path, "collapsed", files=1)
    want = {(r.key, r.delivery_no): (r.status, r.first_seen_at) for r in effects.collapse(d).collect()}
    assert {(r.key, r.delivery_no): (r.status, r.first_seen_at) for r in got} == want


def test_collapse_across_batches_executes_once(spark, sf, tmp_path):
    d = tables.deliveries(spark, sf).where("cast(key as long) < 120").select("key", "delivery_no", "ts")
    got = run(spark, d, streams.collapse, tmp_path, "collapsed3")
    done = [r.key for r in got if r.status == "executed"]
    assert len(done) == len(set(done)) == d.select("key").distinct().count() and len(got) == d.count()


def test_first_deliveries(spark, sf, tmp_path):
    d = tables.deliveries(spark, sf).where("cast(key as long) < 60")
    got = run(spark, d, lambda s: streams.first_deliveries(s, "36500 days").select("ns", "key"), tmp_path, "firsts")
    assert len(got) == d.select("ns", "key").distinct().count()


def test_chain(spark, sf, tmp_path):
    e = tables.audit_log(spark, sf).select("ns", "event_id", "ts", audit.payload().alias("payload"))
    got = run(spark, e, streams.chain, tmp_path, "chained", files=1)
    want = {(r.ns, r.seq): (r.event_id, r.prev_hash, r.hash) for r in audit.chain(tables.audit_log(spark, sf)).collect()}
    assert {(r.ns, r.seq): (r.event_id, r.prev_hash, r.hash) for r in got} == want


def test_gate_ends(spark, tmp_path):
    rows = [("g1", "open", 10, 1_000, "reject"), ("g1", "approved", 500, None, None), ("g1", "rejected", 600, None, None), ("g2", "open", 10, 1_000, "approve"), ("g3", "open", 10, 900, "reject"), ("zz", "open", 9_000_000, 9_900_000, "reject")]
    df = spark.createDataFrame(rows, "id string, op string, ts long, expires_at long, on_timeout string")
    got = run(spark, df, streams.gate_ends, tmp_path, "ends", files=1)
    assert sorted(map(tuple, got)) == [("g1", "approved", 500), ("g2", "approved", 1_000), ("g3", "timed_out", 900)]


def test_lease_ends(spark, tmp_path):
    rows = [("n", "a", 1, "claim", 10, "w1", 1_000, None), ("n", "a", 2, "heartbeat", 800, "w1", 1_000, None), ("n", "a", 3, "complete", 1_700, "w1", 0, "succeeded")]
    rows += [("n", "b", 1, "claim", 10, "w1", 1_000, None), ("n", "b", 2, "complete", 1_011, "w1", 0, "succeeded"), ("n", "c", 1, "claim", 10, "w1", 1_000, None), ("n", "c", 2, "heartbeat", 500, "w9", 1_000, None)]
    rows += [("n", "z", 1, "claim", 9_000_000, "w1", 9_000_000, None)]
    df = spark.createDataFrame(rows, "ns string, key string, n long, op string, ts long, owner string, lease_ms long, status string")
    got = run(spark, df, streams.lease_ends, tmp_path, "leases", files=1)
    assert sorted(tuple(r)[1:] for r in got) == [("a", "succeeded", 1_700), ("b", "indeterminate", 1_010), ("c", "indeterminate", 1_010)]


def test_funded_retries(spark, tmp_path):
    calls = spark.createDataFrame([("c", n, n % 3) for n in range(40)] + [("d", n, 1) for n in range(20)], "circuit string, n long, wanted long")
    got = run(spark, calls, streams.funded, tmp_path, "funded", files=1)
    want = {r.circuit: (r.funded, r.denied) for r in breaker.budget(calls).collect()}
    assert {c: (sum(r.funded for r in got if r.circuit == c), sum(r.denied for r in got if r.circuit == c)) for c in "cd"} == want


def test_worker_clocks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 100, "w1"), ("a", 2, 101, "w2"), ("b", 1, 5, "w3")], "key string, delivery_no long, ts long, worker string")
    skews = spark.createDataFrame([("w1", 50), ("w2", -50)], "worker string, skew_ms long")
    got = run(spark, d, lambda s: streams.collapse(streams.on_worker_clocks(s, skews)), tmp_path, "skewed", files=1)
    assert {(r.key, r.delivery_no): (r.status, r.first_seen_at) for r in got} == {("a", 2): ("executed", 51), ("a", 1): ("replayed", 51), ("b", 1): ("executed", 5)}


@pytest.mark.parametrize("runs", [2])
def test_deliver_once(spark, sf, tmp_path, runs):
    d = tables.deliveries(spark, sf).where("cast(key as long) < 30").select("key", "delivery_no")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    d.write.parquet(source)
    for _ in range(runs):
        stream = spark.readStream.schema(d.schema).parquet(source)
        streams.deliver_once(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(sink).count() == d.count()
