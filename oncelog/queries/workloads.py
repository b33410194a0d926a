"""Queries on seeded workloads: their size is the workload's, not the tables'."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import faults
from ..plans import golden as G
from ..plans import report as R
from ..plans import scenarios as SC
from ..plans import workload as W
from .registry import QUERIES, SQL, query


def _draw(rows: str, keep: str) -> str:
    """CTEs that add the draw u of (seed, label) to rows; ``keep`` are the columns besides."""
    return f"""labelled AS ({rows}),
    h0 AS (SELECT {keep}, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(seed || ':' || label, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM labelled),
    h1 AS (SELECT {keep}, (h + 1831565813) % 4294967296 AS a FROM h0),
    h2 AS (SELECT {keep}, ((xor(a, a >> 15)::HUGEINT * (a | 1)::HUGEINT) % 4294967296)::BIGINT AS t FROM h1),
    h3 AS (SELECT {keep}, xor(t, ((t + (xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296) % 4294967296)::BIGINT) AS t FROM h2),
    drawn AS (SELECT {keep}, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM h3)"""


def _intents(seeds: int, n: int) -> str:
    return f"(SELECT s.range::INTEGER AS seed, 'intent-' || i.range AS intent FROM range(1, {seeds + 1}) s, range({n}) i)"


@query("SELECT s.range::INTEGER AS seed, i.range::INTEGER AS i, 'intent-' || i.range AS intent FROM range(1, 11) s, range(20) i")
def intents(spark, sf):
    return W.intents(spark, 10, 20)


@query(f"WITH {_draw(f'SELECT seed, intent, {chr(39)}deliveries:{chr(39)} || intent AS label FROM {_intents(10, 20)}', 'seed, intent')} SELECT seed, intent, u FROM drawn")
def fault_draws(spark, sf):
    return W.intents(spark, 10, 20).select("seed", "intent", faults.draw(F.col("seed"), F.concat(F.lit("deliveries:"), "intent")).alias("u"))


_DELIVERIES = _draw(f"SELECT seed, intent, 'deliveries:' || intent AS label FROM {_intents(10, 20)}", "seed, intent")


@query(f"WITH {_DELIVERIES} SELECT seed, intent, greatest(1, 2 + floor(u * 4))::INTEGER AS d FROM drawn")
def delivery_counts(spark, sf):
    return W.intents(spark, 10, 20).select("seed", "intent", faults.deliveries_for(F.col("seed"), F.col("intent"), 2, 5).cast("int").alias("d"))


@query(f"WITH {_DELIVERIES} SELECT seed, intent, k::INTEGER AS k, CASE WHEN k % 2 = 0 THEN 'w1' ELSE 'w2' END AS worker FROM (SELECT seed, intent, unnest(range(greatest(1, 2 + floor(u * 4))::BIGINT)) AS k FROM drawn)")
def delivery_fanout(spark, sf):
    return W.fan_out(W.intents(spark, 10, 20), 2, 5).select("seed", "intent", "k", "worker")


_ATTEMPTS = _draw(f"SELECT seed, intent, a.range::INTEGER AS attempt, 'fault:' || intent || ':' || a.range AS label FROM {_intents(10, 20)}, range(1, 16) a", "seed, intent, attempt")
_FAULT = "CASE WHEN u < 0.15 THEN 'error' WHEN u < 0.30 THEN 'timeout' ELSE 'ok' END"


@query(f"WITH {_ATTEMPTS} SELECT seed, intent, attempt, {_FAULT} AS fault FROM drawn")
def attempt_faults(spark, sf):
    return W.fault_table(W.intents(spark, 10, 20), 15, 0.15, 0.15).select("seed", "intent", "attempt", "fault")


@query(f"WITH {_draw(f'SELECT seed, intent, {chr(39)}latency:{chr(39)} || intent || {chr(39)}:1{chr(39)} AS label FROM {_intents(10, 4)}', 'seed, intent')} SELECT seed, intent, floor(5000 + u * 85000 + 0.5)::BIGINT AS latency_ms FROM drawn")
def attempt_latency(spark, sf):
    return W.intents(spark, 10, 4).select("seed", "intent", faults.latency_for(F.col("seed"), F.col("intent"), F.lit(1), 5_000, 90_000).alias("latency_ms"))


_NAIVE = f"""WITH {_DELIVERIES}, d AS (SELECT seed, intent, greatest(1, 2 + floor(u * 4))::BIGINT AS d FROM drawn),
    {_ATTEMPTS.replace('labelled', 'labelled2').replace('h0', 'g0').replace('h1', 'g1').replace('h2', 'g2').replace('h3', 'g3').replace('drawn', 'drawn2')},
    faults AS (SELECT seed, intent, attempt, {_FAULT} AS fault FROM drawn2),
    r1 AS (SELECT d.*, (SELECT count(*) FROM faults f WHERE f.seed = d.seed AND f.intent = d.intent AND attempt <= d AND fault <> 'ok') AS f1 FROM d),
    r2 AS (SELECT r1.*, (SELECT count(*) FROM faults f WHERE f.seed = r1.seed AND f.intent = r1.intent AND attempt > d AND attempt <= d + f1 AND fault <> 'ok') AS f2 FROM r1),
    naive AS (SELECT seed, intent, d AS deliveries, d + f1 + f2 AS attempts, (SELECT count(*) FROM faults f WHERE f.seed = r2.seed AND f.intent = r2.intent AND attempt <= d + f1 + f2 AND fault <> 'error') AS landed,
        (SELECT count(*) FROM faults f WHERE f.seed = r2.seed AND f.intent = r2.intent AND attempt <= d + f1 + f2 AND fault = 'ok') > 0 AS succeeded FROM r2)"""


@query(f"{_NAIVE} SELECT * FROM naive")
def naive_baseline(spark, sf):
    return W.naive(W.intents(spark, 10, 20), 2, 5, 0.15, 0.15)


@query()
def engine_baseline(spark, sf):
    """The same workload through one worker with a shared retry budget: a fold for each seed."""
    return W.client(W.intents(spark, 10, 20), 0.15, 0.15, breaker=False)


@query(f"""{_NAIVE} SELECT 'naive' AS side, count(*) AS intents, sum(attempts)::BIGINT AS attempts, sum(greatest(0, landed - 1))::BIGINT AS duplicates FROM naive
    UNION ALL SELECT 'engine', count(*), sum(n)::BIGINT, 0::BIGINT FROM (SELECT seed, intent, coalesce(min(attempt) FILTER (fault <> 'error'), 3) AS n FROM faults WHERE attempt <= 3 GROUP BY seed, intent)""")
def playground_totals(spark, sf):
    """Both sides of the playground, every retry funded."""
    work = W.intents(spark, 10, 20)
    n, one = F.count(F.lit(1)).alias("intents"), F.sum("attempts").alias("attempts")
    dup = F.sum(F.greatest(F.lit(0), F.col("landed") - 1)).cast("long").alias("duplicates")
    left = W.naive(work, 2, 5, 0.15, 0.15).agg(n, one, dup).select(F.lit("naive").alias("side"), "intents", "attempts", "duplicates")
    right = W.resolution(work, 0.15, 0.15).agg(n, one, dup).select(F.lit("engine").alias("side"), "intents", "attempts", "duplicates")
    return left.unionAll(right)


#: The published figures of the nine scenarios over ten seeds.
_PUBLISHED = [
    ("duplicate-delivery", 60, 214, 60, 60), ("timeout-then-success", 60, 120, 60, 60), ("crash-mid-effect", 30, 60, 30, 30), ("crash-before-effect", 30, 60, 0, 0), ("crash-mid-gate", 20, 40, 20, 20),
    ("retry-storm", 400, 400, 237, 350), ("clock-skew", 40, 80, 40, 40), ("slow-downstream", 40, 40, 40, 40), ("out-of-order-decision", 60, 0, 0, 0),
]


@query("SELECT scenario, intents::BIGINT AS intents, deliveries::BIGINT AS deliveries, ledger::BIGINT AS ledger, attempts::BIGINT AS attempts, 0::BIGINT AS duplicates FROM (VALUES "
    + ", ".join(map(str, _PUBLISHED)) + ") t(scenario, intents, deliveries, ledger, attempts)")
def scenario_rollup(spark, sf):
    """Totals of the nine scenarios, one row each."""
    return W.rollup(W.all_scenarios(spark)).where("scenario IS NOT NULL")


@query("SELECT 740::BIGINT AS intents, 1014::BIGINT AS deliveries, 487::BIGINT AS ledger, 600::BIGINT AS attempts, 0::BIGINT AS duplicates")
def chaos_totals(spark, sf):
    """Grand totals; the SQL has the published figures."""
    return W.rollup(W.all_scenarios(spark)).where("scenario IS NULL").drop("scenario")


for _key, _name in {
    "sc_duplicate_delivery": "duplicate-delivery", "sc_timeout": "timeout-then-success", "sc_crash_mid_effect": "crash-mid-effect", "sc_crash_before_effect": "crash-before-effect",
    "sc_crash_mid_gate": "crash-mid-gate", "sc_retry_storm": "retry-storm", "sc_clock_skew": "clock-skew", "sc_slow_downstream": "slow-downstream", "sc_decision_race": "out-of-order-decision",
}.items():
    QUERIES[_key] = lambda spark, sf, n=_name: W.scenario(spark, n)


def _plain(name: str, n: int, deliveries: str, per: int, status: str) -> str:
    return f"SELECT '{name}' AS scenario, s.range::INTEGER AS seed, 'intent-' || i.range AS intent, {deliveries}::BIGINT AS deliveries, {per}::BIGINT AS attempts, {per}::BIGINT AS landed, {status} AS status FROM range(1, 11) s, range({n}) i"


SQL |= {
    "sc_timeout": _plain("timeout-then-success", 6, "2", 1, "'indeterminate'"),
    "sc_crash_mid_effect": _plain("crash-mid-effect", 3, "2", 1, "'indeterminate'"),
    "sc_crash_before_effect": _plain("crash-before-effect", 3, "2", 0, "'indeterminate'"),
    "sc_crash_mid_gate": _plain("crash-mid-gate", 2, "2", 1, "'succeeded'"),
    "sc_clock_skew": _plain("clock-skew", 4, "2", 1, "CASE WHEN i.range % 2 = 1 THEN 'indeterminate' ELSE 'succeeded' END"),
    "sc_decision_race": _plain("out-of-order-decision", 6, "0", 0, "CASE i.range % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'timed_out' END"),
    "sc_duplicate_delivery": f"WITH {_draw(f'SELECT seed, intent, {chr(39)}deliveries:{chr(39)} || intent AS label FROM {_intents(10, 6)}', 'seed, intent')} "
    "SELECT 'duplicate-delivery' AS scenario, seed, intent, greatest(1, 2 + floor(u * 4))::BIGINT AS deliveries, 1::BIGINT AS attempts, 1::BIGINT AS landed, 'succeeded' AS status FROM drawn",
    "sc_slow_downstream": f"WITH {_draw(f'SELECT seed, intent, {chr(39)}latency:{chr(39)} || intent || {chr(39)}:1{chr(39)} AS label FROM {_intents(10, 4)}', 'seed, intent')} "
    "SELECT 'slow-downstream' AS scenario, seed, intent, 1::BIGINT AS deliveries, 1::BIGINT AS attempts, 1::BIGINT AS landed, CASE WHEN floor(5000 + u * 85000 + 0.5) >= 60000 THEN 'indeterminate' ELSE 'succeeded' END AS status FROM drawn",
}


@query()
def golden_load(spark, sf):
    """The traces that the fixtures expect."""
    return G.expected(G.fixtures(spark))


@query()
def golden_trace(spark, sf):
    """What the fixtures' command logs fold into."""
    return G.replay(G.fixtures(spark))


@query("SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual WHERE false")
def golden_diff(spark, sf):
    """Fields in which a replayed fixture differs from what is expected: none."""
    rows = G.fixtures(spark)
    return G.differences(G.expected(rows), G.replay(rows))


@query("SELECT 24::BIGINT AS total, 24::BIGINT AS passed")
def golden_summary(spark, sf):
    rows = G.fixtures(spark)
    bad = G.differences(G.expected(rows), G.replay(rows)).select("id").distinct()
    x = rows.select("id").join(bad.withColumn("bad", F.lit(True)), "id", "left")
    return x.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bad").isNull()).alias("passed"))


@query()
def fuzz_cases(spark, sf):
    return G.fuzz_cases(spark, 200)


@query("SELECT NULL::VARCHAR AS \"case\", NULL::VARCHAR AS intent, NULL::VARCHAR AS rule WHERE false")
def fuzz_report(spark, sf):
    """Invariants that the fuzzed cases break when they are played: none."""
    return G.fuzz_report(spark, 200)


@query()
def fuzz_runs(spark, sf):
    """What the fuzzed cases leave behind, intent by intent."""
    x = SC.play(G.fuzz_cases(spark, 200))
    return x.select("case", "scenario", "intent", "status", "gate", "deliveries", "attempts", "landed", "reported", "replays", F.array_join("events", " ").alias("events"))


@query("SELECT 954::BIGINT AS samples, 0::BIGINT AS p50, 60000::BIGINT AS p99")
def run_latency(spark, sf):
    """Virtual ms of all runs of the default scenarios whose process lived to report; the SQL has the published figures."""
    d = SC.play(SC.defaults(spark, W.SEEDS)).select(F.explode("durations").alias("ms"))
    return R.latency(d)


@query("SELECT DISTINCT 'naive' AS client, rule FROM (VALUES ('I1')) t(rule)")
def naive_violations(spark, sf):
    """Invariants that the naive client breaks on its workload."""
    return SC.violations(W.as_runs(W.naive(W.intents(spark, 10, 20), 2, 5, 0.15, 0.15))).select(F.lit("naive").alias("client"), "rule").distinct()
