"""Boundaries, folds against plain loops, published figures, planted breaches."""

import hashlib
import hmac
from importlib import resources

import pytest
from pyspark.sql import functions as F

from oncelog import cli
from oncelog.functions import draws, errors, faults
from oncelog.functions import scalars as S
from oncelog.operators import audit, breaker, carry, effects, gates, invariants, metrics, retries, runs
from oncelog.plans import golden, report, scenarios, workload
from oncelog.sources import tables

DELIVERY = "ns string, key string, delivery_no long, ts long, worker string, fault string, fp string, latency_ms long, qty long"


def log(spark, *rows):
    return spark.createDataFrame([("n", k, n, ts, "w1", fault, fp, lat, 1) for k, n, ts, fault, fp, lat in rows], DELIVERY)


def one(df):
    return df.collect()[0]


def scalar(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lease_is_expired_strictly_before_the_claim(spark):
    d = log(spark, ("a", 1, 100, "timeout", None, 0), ("a", 2, 30_100, "ok", None, 0), ("b", 1, 100, "timeout", None, 0), ("b", 2, 30_101, "ok", None, 0))
    assert [(r.key, r.lease_end) for r in effects.lease_expiries(d).collect()] == [("b", 30_100)]
    assert {r.key: r.status for r in effects.fold(d).collect()} == {"a": "in_flight", "b": "indeterminate"}


def test_fold_replays_and_refuses_stale_owners(spark):
    d = log(spark, ("a", 1, 0, "ok", None, 10), ("a", 2, 20, "ok", None, 10), ("b", 1, 0, "ok", None, 90_000), ("b", 2, 40_000, "ok", None, 10), ("c", 1, 0, "error", None, 5), ("c", 2, 9, "ok", None, 1))
    got = {r.key: (r.status, r.attempt, r.replays) for r in effects.fold(d).collect()}
    assert got == {"a": ("succeeded", 1, 1), "b": ("indeterminate", 1, 0), "c": ("failed", 1, 0)}


def test_null_fingerprints_never_conflict(spark):
    d = log(spark, ("a", 1, 0, "ok", "x", 0), ("a", 2, 1, "ok", None, 0), ("a", 3, 2, "ok", "y", 0), ("b", 1, 0, "ok", None, 0), ("b", 2, 1, "ok", "z", 0))
    assert [(r.key, r.delivery_no, r.expected, r.got) for r in effects.key_conflicts(d).collect()] == [("a", 3, "x", "y")]


def test_sweep_boundaries(spark):
    e = spark.createDataFrame([("a", 10, "succeeded"), ("b", 11, "succeeded"), ("c", 1, "in_flight")], "key string, expires_at long, status string")
    assert [r.key for r in effects.sweep(e, F.lit(10)).collect()] == ["a"]


def test_gate_boundaries(spark):
    g = spark.createDataFrame([(f"g{k}", "n", f"g{k}", 0, 100, "approve" if k == 3 else "reject") for k in range(5)], "id string, ns string, key string, created_at long, expires_at long, on_timeout string")
    d = spark.createDataFrame([("g0", 1, 99, "approved", "x"), ("g0", 2, 99, "rejected", "y"), ("g1", 1, 100, "approved", "x"), ("g4", 1, 50, "rejected", "z")], "id string, decision_no long, ts long, decision string, actor string")
    at = lambda now: {r.id: (r.status, r.decided_at) for r in gates.resolve(g, d, F.lit(now)).collect()}
    assert at(100) == {"g0": ("approved", 99), "g1": ("timed_out", 100), "g2": ("timed_out", 100), "g3": ("approved", 100), "g4": ("rejected", 50)}
    assert at(99)["g2"] == ("pending", None)
    late = gates.resolve(g, d, F.lit(100)).withColumn("decided_at", F.when(F.col("id") == "g0", 1_100).when(F.col("id") == "g1", 1_101).otherwise(F.col("decided_at")))
    assert [r.id for r in invariants.gate_liveness(late).collect()] == ["g1"]


def test_gate_claims(spark):
    c = spark.createDataFrame([("g", 300, "w1", "claim"), ("g", 400, "w2", "claim"), ("g", 500, "w2", "ack"), ("g", 30_300, "w2", "claim"), ("g", 30_301, "w3", "claim"), ("g", 40_000, "w3", "ack"), ("g", 99_999, "w1", "claim")], "id string, ts long, owner string, op string")
    r = one(gates.lifecycle(c))
    assert (r.owner, r.processed_at, r.claims) == ("w3", 40_000, 2)


def test_poll_grid(spark):
    ask = lambda at: scalar(spark, gates.poll_observation(F.lit(0), F.lit(at)))
    assert [ask(x) for x in (0, 1, 1_000, 1_001, 2_501)] == [0, 1_000, 1_000, 2_500, 4_750]
    grid, step = 0.0, 1_000.0
    while grid < 5_000_000:
        grid, step = grid + step, min(60_000.0, step * 1.5)
    assert abs(ask(5_000_000) - grid) < 1e-6


def test_chain_and_tampering(spark):
    e = spark.createDataFrame([("n", k, 1_000 + k, "effect", "s", "t", None, "a", '{"i":%d}' % k) for k in range(12)] + [("m", 1, 5, "effect", "é\"", "t", 2, "a", "{}")], "ns string, event_id long, ts long, subject_type string, subject_key string, type string, attempt int, actor string, data string")
    c = audit.chain(e)
    rows = {(r.ns, r.seq): r for r in c.collect()}
    head = None
    for k in range(12):
        payload = f'{{"actor":"a","attempt":null,"data":{{"i":{k}}},"namespace":"n","subjectKey":"s","subjectType":"effect","ts":{1_000 + k},"type":"t"}}'
        head, prev = hashlib.sha256(((head or "") + payload).encode()).hexdigest(), head
        assert (rows["n", k + 1].hash, rows["n", k + 1].prev_hash) == (head, prev)
    assert '"attempt":2' in rows["m", 1].payload and '"subjectKey":"é\\""' in rows["m", 1].payload
    assert {r.ns: r.head_hash for r in audit.heads(e).collect()}["n"] == head
    assert {(r.ns, r.ok, r.checked) for r in audit.verify(c).collect()} == {("n", True, 12), ("m", True, 1)}
    forged = c.withColumn("payload", F.when((F.col("ns") == "n") & (F.col("seq") == 5), "x").otherwise(F.col("payload")))
    assert {(r.ns, r.broken_at, r.checked) for r in audit.verify(forged).collect()} == {("n", 4, 4), ("m", None, 1)}


def plain_breaker(circuit, rows):
    """The breaker written as a loop over times: rows of (n, ts, ok, took)."""
    uniforms = draws.stream(f"1:jitter:{circuit}")
    window, opened, open_ms, opens, refused, version, state, probes, owner, expires, admitted = [], None, None, 0, 0, 0, "closed", 0, None, None, {}
    steps = sorted([(ts, 1, n, ok, took) for n, ts, ok, took in rows] + [(ts + took, 0 if took else 2, n, ok, took) for n, ts, ok, took in rows if took is not None])
    events = []
    for at, kind, n, ok, took in steps:
        if kind == 1:
            if state == "closed":
                probe = False
            elif (state == "open" and at >= opened + open_ms) or (state == "half_open" and expires < at):
                state, owner, expires, version, probes, probe = "half_open", n, at + 30_000, version + 1, probes + 1, True
                events.append((at, n, "circuit.half_open"))
            else:
                refused += 1
                continue
            if took is not None:
                admitted[n] = probe
        elif n in admitted:
            probe, trips = admitted.pop(n), False
            if probe and state == "half_open" and owner == n:
                if ok:
                    state, window, opened, open_ms, opens, version, owner, expires = "closed", [], None, None, 0, version + 1, None, None
                    events.append((at, n, "circuit.closed"))
                trips = not ok
            elif not probe and state == "closed":
                window = [*window, int(not ok)][-20:]
                trips = len(window) >= 5 and sum(window) / len(window) >= 0.5
                version += not trips
            if trips:
                opens += 1
                state, opened, window, version, owner, expires = "open", at, [], version + 1, None, None
                open_ms = int(min(300_000, 30_000 * 2 ** (opens - 1)) * (0.8 + 0.4 * next(uniforms)) + 0.5)
                events.append((at, n, "circuit.opened"))
    return (state, window, opened, open_ms, opens, refused, probes, version), events


def test_breaker_fold_equals_a_loop(spark):
    import random

    r = random.Random(5)
    rows = [(f"c{c}", n, n * 4_000, r.random() > c / 8, r.choice([0, 900, 5_000, 45_000, None])) for c in range(8) for n in range(1, 160)]
    df = spark.createDataFrame(rows, "circuit string, n long, ts long, ok boolean, took long")
    got = {x.circuit: tuple(x)[1:] for x in breaker.fold(df).collect()}
    told = {}
    for e in breaker.events(df).collect():
        told.setdefault(e.circuit, []).append((e.at, e.n, e.type))
    for c in range(8):
        want, events = plain_breaker(f"c{c}", [tuple(x)[1:] for x in rows if x[0] == f"c{c}"])
        assert got[f"c{c}"] == want and told.get(f"c{c}", []) == events
    assert any("circuit.closed" in {t for *_, t in v} for v in told.values())


def test_probe_that_never_answers(spark):
    fails = [("c", n, n * 10, False, 0) for n in range(1, 6)]
    later = [("c", 6, 40_000, True, None), ("c", 7, 50_000, True, 0), ("c", 8, 70_000, True, 0), ("c", 9, 70_001, True, 100), ("c", 10, 70_050, True, 0), ("c", 11, 70_200, True, 0)]
    df = spark.createDataFrame(fails + later, "circuit string, n long, ts long, ok boolean, took long")
    events = [(e.n, e.type) for e in breaker.events(df).orderBy("at").collect()]
    # 6 is a probe that dies, 7 and 8 are refused while it may answer, 9 takes its place, 10 is refused
    assert events == [(5, "circuit.opened"), (6, "circuit.half_open"), (9, "circuit.half_open"), (9, "circuit.closed")]
    assert one(breaker.fold(df)).refused == 3


def test_passes_carry_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(f"k{n % 3}", n) for n in range(100)], "k string, n long")
        out = carry.carry(rows, "k", ["n"], lambda s, r: ((s or 0) + r[1], (r[0], r[1], (s or 0) + r[1])), "k string, n long, total long")
        assert {(r.k, r.n): r.total for r in out.collect()} == {(f"k{n % 3}", n): sum(range(n % 3, n + 1, 3)) for n in range(100)}
        ends = carry.carry(rows, "k", ["n"], lambda s, r: ((s or 0) + 1, None), "k string, m long", end=lambda k, s: (k, s))
        assert sorted(map(tuple, ends.collect())) == [("k0", 34), ("k1", 33), ("k2", 33)]
        assert carry.carry(rows.limit(0), "k", ["n"], lambda s, r: (s, None), "k string, m long", end=lambda k, s: (k, s)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_retry_loop_checks_in_order(spark):
    tries = "array<struct<n:int,kind:string,latency:bigint,hint:bigint,u:double>>"
    bad = lambda n=3, **more: [(k, "retryable", more.get("latency", 10), more.get("hint"), 0.5) for k in range(1, n + 1)]
    cases = {
        "ok": ([(1, "ok", 5, None, 0.0)], 3, 31), "tries": (bad(), 3, 31), "hint": (bad(hint=60_001), 3, 31), "poor": (bad(), 3, 11), "late": ([(1, "ok", 60_000, None, 0.0)], 3, 31), "between": (bad(hint=59_995), 3, 31),
        "lost": ([(1, "retryable", 1, None, 1.0), (2, "indeterminate", 1, None, 0.0)], 3, 31), "never": ([(1, "failed", 1, None, 0.0)], 3, 31), "waits": ([(1, "retryable", 100, 5_000, 0.0), (2, "ok", 100, None, 0.0)], 3, 31),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], f"k string, tries {tries}, most int, balance long")
    got = {r.k: (r.attempts, r.status, r.code, r.balance, len(r.events)) for r in retries.resolve(df, "k").collect()}
    assert got == {
        "ok": (1, "succeeded", None, 31, 0), "tries": (3, "failed", "E_EFFECT_FAILED", 11, 2), "hint": (1, "failed", "E_EFFECT_FAILED", 31, 0), "poor": (2, "failed", "E_RETRY_BUDGET", 1, 2), "late": (1, "indeterminate", "E_DEADLINE", 31, 0),
        "between": (1, "failed", "E_DEADLINE", 21, 0), "lost": (2, "indeterminate", "E_INDETERMINATE", 21, 1), "never": (1, "failed", "E_EFFECT_FAILED", 31, 0), "waits": (2, "succeeded", None, 21, 1),
    }


def test_gate_waits_and_held_gates(spark):
    s = spark.createDataFrame([("a", 0, 5_000, "approved"), ("b", 0, None, "pending"), ("c", 0, 99_000, "approved"), ("d", 0, 1, "rejected")], "id string, created_at long, decided_at long, status string")
    got = {r.id: (r.observed_at, r.code) for r in gates.waits(s, F.col("created_at"), 6_000).collect()}
    assert got == {"a": (6_000.0, None), "b": (6_000.0, "E_WAIT_TIMEOUT"), "c": (6_000.0, "E_WAIT_TIMEOUT"), "d": (1_000.0, None)}
    c = spark.createDataFrame([("a", 10, "w1", "claim"), ("c", 5, "w1", "claim"), ("d", 5, "w1", "claim"), ("d", 6, "w1", "ack")], "id string, ts long, owner string, op string")
    free = lambda now: [r.id for r in gates.claimable(s, claims=c, now=F.lit(now)).collect()]
    assert free(4) == ["a", "c", "d"] and free(20) == [] and free(30_006) == ["c"] and free(30_011) == ["a", "c"]


def test_conditional_writes(spark):
    w = spark.createDataFrame([("c", 1, None), ("c", 2, None), ("c", 3, 1), ("c", 4, 1), ("c", 5, 2)], "circuit string, n long, expected long")
    assert tuple(one(breaker.compare_and_set(w)))[1:] == (3, 3, 2)


def test_budget_shape(spark):
    calls = spark.createDataFrame([("c", n, 1) for n in range(20)], "circuit string, n long, wanted long")
    r = one(breaker.budget(calls))
    assert (r.funded, r.denied) == (5, 15)


def test_percentile_rule(spark):
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int")
    assert one(metrics.percentile(v, "v", 0.5)).p50 == 3 and one(metrics.percentile(v, "v", 0.99)).p99 == 4
    assert metrics.percentile(v.limit(0), "v", 0.5).count() == 0
    assert one(metrics.percentile(spark.createDataFrame([(7,)] * 5, "v int"), "v", 0.5)).p50 == 7


def test_published_figures(spark):
    work = workload.intents(spark, 10, 20)
    naive = one(workload.naive(work, 2, 5, 0.15, 0.15).selectExpr("sum(deliveries) d", "sum(attempts) a", "sum(greatest(0, landed - 1)) x", "count_if(succeeded) s"))
    assert (naive.d, naive.a, naive.x, naive.s) == (714, 1_031, 666, 200)
    engine = {r.code: (r.n, r.a) for r in workload.client(work, 0.15, 0.15, breaker=False).groupBy("code").agg(F.count("*").alias("n"), F.sum("attempts").alias("a")).collect()}
    assert {k: v[0] for k, v in engine.items()} == {"ok": 154, "E_INDETERMINATE": 40, "E_RETRY_BUDGET": 6} and sum(v[1] for v in engine.values()) == 228
    storm = {r.code: (r.n, r.a) for r in workload.client(workload.intents(spark, 10, 40), 0.3).groupBy("code").agg(F.count("*").alias("n"), F.sum("attempts").alias("a")).collect()}
    assert {k: v[0] for k, v in storm.items()} == {"ok": 237, "E_CIRCUIT_OPEN": 106, "E_RETRY_BUDGET": 54, "E_EFFECT_FAILED": 3} and sum(v[1] for v in storm.values()) == 350


def test_draw_vectors(spark):
    for seed, label, h, u in ((1, "fault:intent-0:1", 1542647338, 0.7205177049618214), (7, "deliveries:intent-19", 8056205, 0.036326739471405745)):
        assert scalar(spark, faults.fnv1a(F.lit(f"{seed}:{label}"))) == h and scalar(spark, faults.draw(F.lit(seed), F.lit(label))) == u


def test_goldens_and_report(spark, tmp_path):
    rows = golden.fixtures(spark)
    actual = golden.replay(rows).persist()
    assert golden.differences(golden.expected(rows), actual).count() == 0
    broken = golden.expected(rows).withColumn("ledger", F.when(F.col("id").startswith("08"), 2).otherwise(F.col("ledger")))
    assert [(d.id[:2], d.field) for d in golden.differences(broken, actual).collect()] == [("08", "ledger")]
    actual.unpersist()
    (tmp_path / "fixtures").mkdir()
    text = next(line for line in (resources.files("oncelog.plans") / "fixtures.json").read_text().splitlines() if "17-retry" in line)
    (tmp_path / "fixtures" / "one.json").write_text(text.rstrip(","))
    assert [(t.attempts, t.events.split()[-2:]) for t in golden.replay(golden.load(spark, str(tmp_path / "fixtures"))).collect()] == [(4, ["retry.budget_exhausted", "effect.failed"])]
    result = report.results(spark)
    report.write(result, str(tmp_path / "results"), "2026-01-01", "abc")
    row = one(spark.read.json(str(tmp_path / "results" / "latest")))
    text = report.markdown(row)
    assert "| retry-storm | 400 | 400 | 237 | 350 | 0 |" in text and "77 % succeeded" in text and "24 of 24" in text and row.totals.deliveries == 1_014
    assert "storm: 0.875. Invariants broken: 0." in text and "Runs: 954, p50 0 ms, p99 60,000 ms" in text and row.engine.duplicates == 0
    dated = spark.read.json(str(tmp_path / "results" / "2026-01-01-abc"))
    assert golden.drift(spark.createDataFrame([row]), dated, "day").count() == 0 and golden.drift(spark.createDataFrame([row]), dated.withColumn("violations", F.lit(1)), "day").count() == 2
    marked = "a\n<!-- report:begin -->\nold\n<!-- report:end -->\nb"
    assert report.inject(marked, text).count("retry-storm") == 1
    with pytest.raises(ValueError):
        report.inject("none", text)


def test_fuzzed_cases_and_planted_breaches(spark):
    played = scenarios.play(golden.fuzz_cases(spark, 60)).persist()
    assert scenarios.violations(played).count() == 0 and played.select("scenario").distinct().count() == 9
    hit = lambda where, **to: {r.rule for r in scenarios.violations(played.where(where).withColumns({k: F.expr(v) for k, v in to.items()})).collect()}
    good = "status = 'succeeded' AND scenario <> 'retry-storm'"
    assert hit(good, landed="2L") == {"I1"} | ({"I5"} if played.where("scenario = 'crash-mid-gate'").count() else set())
    assert "I2" in hit(good, landed="0L") and hit("scenario = 'timeout-then-success'", reported="1L") == {"I3"}
    assert hit("status = 'indeterminate' AND called_at IS NOT NULL", called_at="parked_at + 1") == {"I3"}
    assert hit("gate = 'approved'", gate="'pending'") == {"I4"} and hit("gate = 'timed_out'", decided_at="expires_at + 1001") == {"I4"}
    assert "I6" in hit("scenario = 'retry-storm'", attempts="9L")
    assert hit(good, events="array('effect.claimed')") == {"I7"} and hit(good, events="concat(events, array('effect.failed'))") == {"I8"}
    assert hit("replays > 0", events="filter(events, e -> e <> 'effect.replayed')") == {"I7"}
    # an engine that executes every delivery again is found out
    played.unpersist()
    again = lambda cases: scenarios.play(cases).withColumn("landed", F.greatest("landed", F.when(F.col("scenario") == "duplicate-delivery", F.col("deliveries"))))
    assert {r.rule for r in golden.fuzz_report(spark, 60, again).collect()} == {"I1"}


def test_command_tables_fold_like_logs(spark):
    case = [scenarios.case("crash-mid-gate", 3, crashes=2), scenarios.case("clock-skew", 4)]
    logs = scenarios.logs(scenarios.cases(spark, case))
    table = logs.select("case", "i", F.explode("log").alias("c")).select("case", "i", "c.*")
    whole = lambda df: sorted((r.case, r.i, r.status, r.gate, r.attempts, r.landed, tuple(r.events)) for r in df.collect())
    names = ["case", "i", "status", "gate", "attempts", "landed", "events"]
    assert whole(runs.fold(runs.collected(table, "case", "i"), "case", "i").select(*names)) == whole(scenarios.play(scenarios.cases(spark, case)).select(*names))


def test_planted_breaches(spark):
    keys = lambda rows, schema: spark.createDataFrame(rows, schema)
    i = keys([("a",), ("b",), ("c",)], "key string")
    n, r = keys([("a", 2), ("b", 1)], "key string, n long"), keys([("b", 1), ("c", 1)], "key string, reported long")
    assert sorted(x.key for x in invariants.exactly_once(i, n, r).collect()) == ["a", "c"]
    assert [x.key for x in invariants.phantom_success(r, keys([("b",)], "key string")).collect()] == ["c"]
    parked, tries = keys([("a", 10)], "key string, parked_at long"), keys([("a", 1, 10), ("a", 2, 11)], "key string, delivery_no long, ts long")
    assert [x.delivery_no for x in invariants.fail_closed(parked, tries).collect()] == [2]
    moves = keys([("a", 1, "in_flight"), ("a", 2, "indeterminate"), ("a", 3, "in_flight"), ("a", 4, "succeeded"), ("b", 1, "succeeded"), ("b", 2, "failed"), ("c", 1, "indeterminate"), ("c", 2, "succeeded")], "key string, n long, status string")
    assert sorted(x.key for x in invariants.monotonic(moves).collect()) == ["b", "c"]
    assert [x.key for x in invariants.resumed_once(i, n).collect() if x.n == 2] == ["a"]


def test_tokens(spark):
    token = scalar(spark, S.mint_token(F.lit("gate-1"), F.lit(1_000), F.lit("abc"), F.lit("k")))
    body, mac = token.split(".")
    assert mac == hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest() and "=" not in body
    check = lambda t, now=1_000, gate="gate-1", key="k": scalar(spark, S.token_is_valid(F.lit(t), F.lit(key), F.lit(gate), F.lit(now)))
    assert check(token) and not check(token, now=1_001) and not check(token, gate="gate-2") and not check(token, key="x")
    assert not check(token[:-1] + "0") and not check("rubbish") and not check("")
    assert scalar(spark, S.hmac_sha256_hex(F.lit("Jefe"), F.lit("what do ya want for nothing?"))).startswith("5bdcc146")


def test_base64url(spark):
    for raw in (b"", b"f", b"fo", b"foo", b"\xff\xfe\xfd" * 60):
        text = scalar(spark, S.base64url(F.lit(raw)))
        assert not set(text) & set("+/=\r\n") and bytes(scalar(spark, S.base64url_decode(F.lit(text)))) == raw
    assert scalar(spark, S.base64url_decode(F.lit("a"))) is None and scalar(spark, S.base64url_decode(F.lit("ab$d"))) is None


def test_retry_after_and_sizes(spark):
    ask = lambda raw, now=0: scalar(spark, S.retry_after_ms(F.lit(raw), F.lit(now).cast("long")))
    assert ask("5") == 5_000 and ask("soon") is None and ask("Thu, 01 Jan 1970 00:00:10 GMT", 4_000) == 6_000 and ask("Thu, 01 Jan 1970 00:00:10 GMT", 99_000) == 0
    assert scalar(spark, S.result_class(F.lit("x" * 65_536))) == "stored" and scalar(spark, S.result_class(F.lit("x" * 65_537))) == "omitted" and scalar(spark, S.result_class(F.lit("é" * 32_769))) == "omitted"


def test_uuid_shape(spark):
    import uuid

    u = uuid.UUID(scalar(spark, S.uuidv7(F.lit(1_700_000_000_123).cast("long"), F.lit(5).cast("long"), F.lit(9).cast("long"))))
    assert u.version == 7 and u.variant == uuid.RFC_4122 and u.int >> 80 == 1_700_000_000_123


def test_session_zone_does_not_matter(spark, sf):
    ask = lambda: tables.audit_log(spark, sf).agg(F.sum("ts")).first()[0]
    utc = ask()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert ask() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_cli(spark, tmp_path, capsys):
    state = str(tmp_path / "gates")
    rows = [("g1", "n", "a", "pending", 0, 100, "approve", None, None, None), ("g2", "n", "b", "pending", 1, 10_000, "reject", None, None, None), ("g3", "m", "c", "pending", 2, 10_000, "reject", None, None, None)]
    spark.createDataFrame(rows, cli.GATE).write.json(state)
    run = lambda *a: (cli.main(["gates", *a, "--state", state], spark, 500), capsys.readouterr().out)
    assert run("ls") == (0, "g1\tn\tapproved\ng2\tn\tpending\ng3\tm\tpending\n")
    assert run("reject", "g2", "--reason", "no") == (0, "g2\tn\trejected\n") and run("approve", "g2")[1] == "g2\tn\trejected\n"
    assert run("ls", "--status", "pending")[1] == "g3\tm\tpending\n" and run("ls", "--namespace", "m")[1].startswith("g3")
    assert '"decided_by":"engine:timeout"' in run("show", "g1")[1] and run("show", "zz") == (0, "no such gate\n")
    assert cli.main(["gates", "ls", "--status", "odd"], spark) == 2 and cli.main(["nothing"], spark) == 2
    assert cli.main(["gates", "ls", "--state", str(tmp_path / "none")], spark, 0) == 0
    assert cli.main(["chaos", "--seed", "2"], spark) == 0 and "retry-storm: 80 intents" in capsys.readouterr().out
    assert cli.main(["chaos", "--seeds", "2", "--client", "naive"], spark) == 1 and "I1: broken" in capsys.readouterr().out


def test_small_scalars(spark):
    assert scalar(spark, S.ascii_text(F.lit(b"abc"))) == "abc" and scalar(spark, S.ascii_text(F.lit("é".encode()))) == "" and scalar(spark, S.ascii_text(F.lit(b"\xff"))) == ""
    none = F.lit(None).cast("string")
    assert [scalar(spark, S.safe_message(m, t)) for m, t in ((F.lit("m"), none), (none, F.lit("t")), (none, none))] == ["m", "t", "unknown error"]
    assert scalar(spark, S.percent(F.lit(0.765))) == "77 %" and scalar(spark, S.thousands(F.lit(1031))) == "1,031"


def test_append_continues_the_chain(spark, sf):
    events = tables.audit_log(spark, sf)
    whole = {(r.ns, r.seq): (r.event_id, r.prev_hash, r.hash) for r in audit.chain(events).collect()}
    cut = events.select(F.percentile_approx("ts", 0.6)).first()[0]
    first = audit.append(None, events.where(F.col("ts") <= cut))
    both = first.unionByName(audit.append(first, events.where(F.col("ts") > cut)))
    assert {(r.ns, r.seq): (r.event_id, r.prev_hash, r.hash) for r in both.collect()} == whole
    bare = spark.createDataFrame([("effect", "k", "note", 5, 1, None)], "subject_type string, subject_key string, type string, ts long, event_id long, ns string")
    r = audit.with_defaults(bare, "n", "me").first()
    assert (r.ns, r.actor, r.data, r.attempt) == ("n", "me", "{}", None)
    assert audit.notes(tables.deliveries(spark, sf).limit(1), F.lit('say "x"')).first().data == '{"note":"say \\"x\\""}'


def test_minimiser():
    case = scenarios.case("retry-storm", 1, intents=30, timeout=0.1, variant="v", latency_low=5, latency_high=5)
    small = golden.minimize(case, lambda c: c["intents"] >= 7 and c["error"] > 0)
    assert small == case | {"intents": 7, "timeout": 0.0, "variant": "", "latency_low": 0, "latency_high": 0}
    assert golden.pinned(small, {"ledger": 1}).startswith('{\n  "case": {\n    "case"')


def test_nested_canonical_json_and_flags(spark):
    ask = lambda text: scalar(spark, S.canonical_json(F.lit(text)))
    assert ask('{ "b" : [1, {"z":1,"a":"\u00e9"}], "a": {"y":null,"x":true} }') == '{"a":{"x":true,"y":null},"b":[1,{"a":"é","z":1}]}'
    assert ask('{"a": NaN}') is None and ask("Infinity") is None and ask("{") is None and ask('"s"') == '"s"'
    flag = lambda code, flying=False: (scalar(spark, errors.retryable(F.lit(code))), scalar(spark, errors.indeterminate(F.lit(code), F.lit(flying))))
    assert flag("E_CIRCUIT_OPEN") == (True, False) and flag("E_LEASE_LOST") == (False, True) and flag("E_DEADLINE") == (False, False) and flag("E_DEADLINE", True) == (False, True)
    assert len(errors.CODES) == 14 and scalar(spark, errors.retryable(F.lit(None).cast("string"))) is None


def test_records_of_a_key_with_many_commands_are_folded_in_one_pass(spark):
    from oncelog.operators import commands as C

    def row(key, n, op, now, owner="a", **more):
        base = {"ns": "n", "key": key, "n": n, "op": op, "now": now, "owner": owner, "fp": "f", "lease_ms": 30, "retention_ms": 100, "reclaim": False, "status": "succeeded", "result": None}
        return tuple((base | more).values())

    beats = [row("hot", n, "heartbeat", n) for n in range(1, 5_000)]
    log = [row("hot", 0, "claim", 0), *beats, row("hot", 5_000, "complete", 5_000, result="r"), row(None, 1, "claim", 1), row("swept", 1, "claim", 1), row("swept", 2, "complete", 2), row("swept", 3, "sweep", 200)]
    out = C.records(spark.createDataFrame(log, C.COMMAND).repartition(3))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.key: (r.status, r.attempt, r.lease_end, r.updated_at, r.expires_at, r.result) for r in out.collect()}
    assert got == {"hot": ("succeeded", 1, None, 5_000, 100, "r"), None: ("in_flight", 1, 31, 1, 101, None)}


def test_answers_of_a_key_with_many_commands_are_told_as_they_pass(spark):
    from oncelog.operators import commands as C

    def row(n, op, owner="a", **more):
        base = {"ns": "n", "key": "hot", "n": n, "op": op, "now": n, "owner": owner, "fp": "f", "lease_ms": 1_000_000, "retention_ms": 100, "reclaim": False, "status": "failed", "result": None}
        return tuple((base | more).values())

    tries = [row(n, "claim", f"b{n}", fp="f" if n % 2 else "g", lease_ms=None, reclaim=None) for n in range(1, 5_000)]
    log = [row(0, "claim"), *tries, row(5_000, "complete", None), row(5_001, "complete"), row(5_002, "sweep"), row(5_003, "heartbeat")]
    out = C.answers(spark.createDataFrame(log, C.COMMAND).repartition(3))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.n: (r.outcome, r.status, r.attempt, r.expired, r.code) for r in out.collect()}
    assert len(got) == len(log)
    assert all(got[n] == ("exists", "in_flight", 1, False, None if n % 2 else "E_KEY_CONFLICT") for n in range(1, 5_000))
    assert [got[n] for n in (0, 5_000)] == [("claimed", "in_flight", 1, False, None), ("refused", "in_flight", 1, False, "E_LEASE_LOST")]  # no owner: the lease is another's
    assert [got[n] for n in (5_001, 5_002, 5_003)] == [("ok", "failed", 1, False, None), ("removed", "failed", 1, False, None), ("not_ok", None, None, False, None)]


@pytest.mark.parametrize("batch", [7, 150, 10_000])
def test_commands_folded_side_by_side_are_those_folded_one_by_one(spark, batch):
    import random

    from oncelog.operators import commands as C

    draw = random.Random(5)
    pick = lambda *x: draw.choice(x)
    log = []
    for k in range(300):
        for n in range(pick(1, 3, 8, 20) if k else 400):
            op = pick("claim", "claim", "claim", "heartbeat", "complete", "sweep", "other", None) if n else "claim"
            now = pick(n * 10, n * 10, n * 10, None, 1 << 62 if k % 97 == 5 else n * 10, (1 << 63) - 1 if k == 8 and n == 2 else 0)
            log.append((pick("n", "m") if k % 50 == 3 else None if k % 50 == 4 else "n", None if k == 7 else f"k{k}", n, op, now, pick("a", "a", "b", None), pick("f", "f", "g", None), pick(15, 60, None), pick(40, 40, None), pick(True, False, None), pick("succeeded", "failed", "in_flight", "indeterminate", None), pick("r", "s", None)))
    keyed = {}
    for row in sorted(log, key=lambda r: (-(1 << 64) if r[4] is None else r[4], r[2])):
        keyed.setdefault(row[:2], []).append(row)
    answers, ends, plain = [], [], []
    for key, rows in keyed.items():
        record = C._NONE
        for row in rows:
            record, told = C._step(record, row)
            answers.append(told)
        plain.append((key, record))
    ends = [(*key, *record) for key, record in plain if record[0] is not None]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(log, C.COMMAND).repartition(3)
        assert sorted(map(repr, map(tuple, C.answers(df).collect()))) == sorted(map(repr, answers))
        small = df.where("key IS NULL OR key <> 'k8'")  # its lease ends beyond 64 bits, which no record holds
        assert sorted(map(repr, map(tuple, C.records(small).collect()))) == sorted(repr(r) for r in ends if r[1] != "k8")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_commands_of_deliveries_are_shuffled_once(spark, sf):
    from oncelog.queries import QUERIES

    for name in ("command_answers", "effect_commands"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan
