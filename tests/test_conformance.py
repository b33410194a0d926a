"""The store's conformance cases, as command logs."""

from oncelog.operators import audit, breaker, commands, gates


def run(spark, *rows):
    """(op, now, owner, extra) commands on one key; answers in order and the record."""
    out = []
    for n, (op, now, owner, *more) in enumerate(rows):
        x = dict(more[0]) if more else {}
        out.append(("conf", x.get("key", "k1"), n, op, now, owner, x.get("fp", "fp-1"), 30_000, x.get("retention", 604_800_000), x.get("reclaim", False), x.get("status"), x.get("result")))
    df = spark.createDataFrame(out, commands.COMMAND)
    answers = {r.n: r for r in commands.answers(df).collect()}
    record = {r.key: r for r in commands.records(df).collect()}
    return [answers[k] for k in range(len(rows))], record.get("k1")


def test_new_claim(spark):
    (a,), r = run(spark, ("claim", 100, "w1"))
    assert (a.outcome, a.attempt, a.expired, r.lease_end, r.expires_at) == ("claimed", 1, False, 30_100, 604_800_100)


def test_live_lease(spark):
    a, r = run(spark, ("claim", 100, "w1"), ("claim", 200, "w2"))
    assert (a[1].outcome, r.owner, r.status) == ("exists", "w1", "in_flight")


def test_expired_lease_then_reclaim(spark):
    a, r = run(spark, ("claim", 100, "w1"), ("claim", 40_000, "w2"))
    assert (a[1].outcome, a[1].expired, a[1].status, r.owner, r.code) == ("exists", True, "indeterminate", None, "E_LEASE_LOST")
    a, r = run(spark, ("claim", 100, "w1"), ("claim", 40_000, "w2", {"reclaim": True}), ("claim", 40_100, "w2", {"reclaim": True}), ("claim", 40_200, "w3", {"reclaim": True}))
    assert [x.outcome for x in a] == ["claimed", "exists", "claimed", "exists"] and (r.attempt, r.owner, r.created_at, r.fp) == (2, "w2", 100, "fp-1")


def test_lease_end_is_inclusive(spark):
    a, r = run(spark, ("claim", 100, "w1"), ("claim", 30_100, "w2"))
    assert not a[1].expired and r.status == "in_flight"


def test_complete_and_replay(spark):
    a, r = run(spark, ("claim", 100, "w1"), ("complete", 200, "w1", {"status": "succeeded", "result": '{"x":1}'}), ("claim", 300, "w2"))
    assert (a[1].outcome, a[2].outcome, a[2].status, r.result, r.owner, r.updated_at) == ("ok", "exists", "succeeded", '{"x":1}', None, 200)


def test_stale_owner(spark):
    a, r = run(spark, ("claim", 100, "w1"), ("claim", 40_000, "w2"), ("complete", 40_100, "w1", {"status": "succeeded"}))
    assert (a[2].outcome, a[2].code, r.status) == ("refused", "E_LEASE_LOST", "indeterminate")


def test_complete_without_record(spark):
    a, r = run(spark, ("complete", 1, "w1", {"status": "succeeded"}))
    assert a[0].code == "E_STORE" and r is None


def test_heartbeat(spark):
    a, r = run(spark, ("claim", 100, "w1"), ("heartbeat", 10_000, "w1"), ("heartbeat", 10_050, "w9"))
    assert ([x.outcome for x in a[1:]], r.lease_end) == (["ok", "not_ok"], 40_000)


def test_conflict_and_null_fingerprints(spark):
    a, _ = run(spark, ("claim", 1, "w1"), ("claim", 2, "w2", {"fp": "fp-2"}), ("claim", 3, "w2", {"fp": None}))
    assert [x.code for x in a] == [None, "E_KEY_CONFLICT", None]


def test_sweep(spark):
    a, r = run(spark, ("claim", 1, "w1", {"retention": 1_000}), ("complete", 2, "w1", {"status": "failed"}), ("sweep", 1_000, None), ("sweep", 1_001, None), ("claim", 2_000, "w2"), ("sweep", 700_000_000, None))
    assert [x.outcome for x in a] == ["claimed", "ok", "kept", "removed", "claimed", "kept"] and r.created_at == 2_000


def test_gate_opens_once_and_decides_once(spark):
    g = spark.createDataFrame([("a", "n", "k", 1), ("b", "n", "k", 2), ("c", "m", "k", 3)], "id string, ns string, key string, created_at long")
    assert sorted(r.id for r in gates.open_gates(g).collect()) == ["a", "c"]


def test_circuit_cas(spark):
    w = spark.createDataFrame([("c", 1, None), ("c", 2, None), ("c", 3, 1), ("c", 4, 1)], "circuit string, n long, expected long")
    r = breaker.compare_and_set(w).first()
    assert (r.applied, r.refused, r.version) == (2, 2, 2)


def test_events_are_numbered_by_namespace(spark):
    e = spark.createDataFrame([("conf", 1, 5), ("conf", 2, 6), ("conf2", 3, 7)], "ns string, event_id long, ts long")
    s = audit.sequence(e)
    assert sorted((r.ns, r.seq) for r in s.collect()) == [("conf", 1), ("conf", 2), ("conf2", 1)]
    assert [r.event_id for r in audit.since(s, "conf", 1).collect()] == [2] and [r.page for r in audit.pages(s, 1).orderBy("ns", "seq").collect()] == [0, 1, 0]
