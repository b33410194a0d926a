"""Queries on effects, retries and breakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors as X
from ..functions import scalars as S
from ..operators import breaker as B
from ..operators import commands as C
from ..operators import effects as E
from ..operators import retries as RL
from ..sources import tables as T
from .registry import query

_FIRST = "PARTITION BY ns, key ORDER BY ts, delivery_no"
_WIN = f"win AS (SELECT * FROM (SELECT *, row_number() OVER ({_FIRST}) AS rn FROM deliveries) WHERE rn = 1)"
#: An effect's record after its first delivery.
_EFFECTS = """effects AS (SELECT ns, key, CASE fault WHEN 'ok' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'timeout' THEN (CASE WHEN qty > 40 THEN 'in_flight' ELSE 'indeterminate' END) END AS status,
    1::BIGINT AS attempt, ts + latency_ms + 604800000 AS expires_at FROM win)"""
_NOW = 800_000_000_000


def effects(spark: SparkSession, sf: str) -> DataFrame:
    win = E.claim_winners(T.deliveries(spark, sf))
    status = F.when(F.col("fault") == "ok", "succeeded").when(F.col("fault") == "error", "failed").when(F.col("qty") > 40, "in_flight").otherwise("indeterminate")
    return win.select("ns", "key", status.alias("status"), F.lit(1).cast("long").alias("attempt"), (F.col("ts") + F.col("latency_ms") + S.RETENTION_MS).alias("expires_at"))


@query(T.oracle("SELECT * FROM effects WHERE ns = 'ns1' AND key = '1'", "deliveries", more=f"{_WIN}, {_EFFECTS}"))
def effect_inspect(spark, sf):
    return E.inspect(effects(spark, sf), "ns1", "1")


@query(T.oracle("SELECT ns, key, delivery_no, ts, worker, fault FROM win", "deliveries", more=_WIN))
def effect_claim_winner(spark, sf):
    return E.claim_winners(T.deliveries(spark, sf)).select("ns", "key", "delivery_no", "ts", "worker", "fault")


@query(T.oracle(f"SELECT ns, key, delivery_no, CASE WHEN row_number() OVER ({_FIRST}) = 1 THEN 'executed' ELSE 'replayed' END AS status, min(ts) OVER (PARTITION BY ns, key) AS first_seen_at FROM deliveries", "deliveries"))
def dup_collapse(spark, sf):
    return E.collapse(T.deliveries(spark, sf))


@query(T.oracle("""SELECT d.ns, d.key, d.delivery_no, w.delivery_no AS winner, CASE w.fault WHEN 'ok' THEN 'replayed' WHEN 'error' THEN 'E_EFFECT_FAILED' ELSE 'E_INDETERMINATE' END AS told
    FROM deliveries d JOIN win w USING (ns, key) WHERE d.delivery_no <> w.delivery_no""", "deliveries", more=_WIN))  # fmt: skip
def replay_outcomes(spark, sf):
    return E.replays(T.deliveries(spark, sf))


@query(T.oracle("SELECT d.ns, d.key, d.delivery_no, w.fp AS expected, d.fp AS got FROM deliveries d JOIN win w USING (ns, key) WHERE d.fp <> w.fp", "deliveries", more=_WIN))
def key_conflicts(spark, sf):
    return E.key_conflicts(T.deliveries(spark, sf))


@query(T.oracle("SELECT ns, key, delivery_no, latency_ms // 10000 AS beats, ts + (latency_ms // 10000) * 10000 + 30000 AS lease_end FROM deliveries", "deliveries"))
def lease_extension(spark, sf):
    return E.lease_ends(T.deliveries(spark, sf))


@query(T.oracle("SELECT ns, key, delivery_no, ts + 30000 AS lease_end, next_claim FROM ahead WHERE rn = 1 AND fault = 'timeout' AND ts + 30000 < next_claim", "deliveries",
    more=f"ahead AS (SELECT *, lead(ts) OVER ({_FIRST}) AS next_claim, row_number() OVER ({_FIRST}) AS rn FROM deliveries)"))
def lease_expiry(spark, sf):
    return E.lease_expiries(T.deliveries(spark, sf))


@query(T.oracle("""SELECT ns, key, ts + latency_ms AS completed_at, CASE WHEN lost THEN 'indeterminate' WHEN fault = 'ok' THEN 'succeeded' WHEN fault = 'error' THEN 'failed' ELSE 'indeterminate' END AS status,
    CASE WHEN lost THEN 'E_LEASE_LOST' END AS code FROM (SELECT *, coalesce(next_claim <= ts + latency_ms AND ts + 30000 < next_claim, false) AS lost FROM ahead WHERE rn = 1)""", "deliveries",
    more=f"ahead AS (SELECT *, lead(ts) OVER ({_FIRST}) AS next_claim, row_number() OVER ({_FIRST}) AS rn FROM deliveries)"))
def effect_complete(spark, sf):
    return E.completions(T.deliveries(spark, sf))


@query(T.oracle("""SELECT ns, key, delivery_no, least(seen, lim) AS observed_at, CASE WHEN seen > lim THEN 'E_WAIT_TIMEOUT' ELSE 'terminal' END AS result FROM
    (SELECT d.*, d.ts + 60000 AS lim, CASE WHEN w.ts + w.latency_ms <= d.ts THEN d.ts ELSE d.ts + greatest(1, (w.ts + w.latency_ms - d.ts + 24) // 25) * 25 END AS seen
     FROM deliveries d JOIN win w USING (ns, key) WHERE d.delivery_no <> w.delivery_no)""", "deliveries", more=_WIN))  # fmt: skip
def wait_outcomes(spark, sf):
    return E.waits(T.deliveries(spark, sf))


@query(T.oracle(f"SELECT status, count(*) AS swept FROM effects WHERE expires_at <= {_NOW} AND status <> 'in_flight' GROUP BY status", "deliveries", more=f"{_WIN}, {_EFFECTS}"))
def retention_sweep(spark, sf):
    return E.sweep(effects(spark, sf), F.lit(_NOW)).groupBy("status").agg(F.count(F.lit(1)).alias("swept"))


_POLICY = "CASE key::BIGINT % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'reclaim' ELSE 'gate' END"


@query(T.oracle(f"""SELECT ns, key, CASE {_POLICY} WHEN 'reclaim' THEN 'claimed' WHEN 'gate' THEN 'gate_opened' ELSE 'E_INDETERMINATE' END AS action,
    attempt + CASE WHEN {_POLICY} = 'reclaim' THEN 1 ELSE 0 END AS next_attempt FROM effects WHERE status = 'indeterminate'""", "deliveries", more=f"{_WIN}, {_EFFECTS}"))  # fmt: skip
def indeterminate_policy(spark, sf):
    policy = F.element_at(F.array(F.lit("fail"), F.lit("reclaim"), F.lit("gate")), (F.col("key").cast("long") % 3 + 1).cast("int"))
    return E.policies(effects(spark, sf).where("status = 'indeterminate'"), policy).select("ns", "key", "action", "next_attempt")


@query(T.oracle(f"""SELECT d.ns, d.key, d.delivery_no, CASE WHEN d.fp <> w.fp THEN 'E_KEY_CONFLICT' WHEN e.status = 'succeeded' THEN 'replayed' WHEN e.status = 'failed' THEN 'E_EFFECT_FAILED'
    WHEN e.status = 'indeterminate' AND {_POLICY.replace('key::', 'd.key::')} = 'fail' THEN 'E_INDETERMINATE' ELSE 'E_CIRCUIT_OPEN' END AS settled
    FROM deliveries d LEFT JOIN effects e USING (ns, key) LEFT JOIN win w USING (ns, key) WHERE d.delivery_no > 1""", "deliveries", more=f"{_WIN}, {_EFFECTS}"))  # fmt: skip
def circuit_open_settle(spark, sf):
    """What callers get while the breaker is open."""
    policy = F.element_at(F.array(F.lit("fail"), F.lit("reclaim"), F.lit("gate")), (F.col("key").cast("long") % 3 + 1).cast("int"))
    d = T.deliveries(spark, sf)
    stored = effects(spark, sf).select("ns", "key", "status").join(E.claim_winners(d).select("ns", "key", F.col("fp").alias("stored")), ["ns", "key"])
    return E.settle_unexecuted(d.where("delivery_no > 1"), stored, policy)


@query(T.oracle("SELECT ns, key, delivery_no, CASE WHEN latency_ms > 30000 THEN 'indeterminate' WHEN fault = 'ok' THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN latency_ms > 30000 THEN 'E_DEADLINE' END AS stored_code FROM deliveries", "deliveries"))
def deadline_outcomes(spark, sf):
    return E.deadline_outcomes(T.deliveries(spark, sf), F.lit(30_000))


@query(T.oracle("""SELECT ns, key, code, count(*) AS n FROM (SELECT ns, key, CASE WHEN fault = 'timeout' THEN 'E_INDETERMINATE' WHEN fault = 'error' AND latency_ms > 40000 THEN 'E_DEADLINE'
    WHEN fault = 'error' THEN 'E_EFFECT_FAILED' END AS code FROM deliveries) WHERE code IS NOT NULL GROUP BY ns, key, code""", "deliveries"))  # fmt: skip
def terminal_errors(spark, sf):
    code = F.when(F.col("fault") == "timeout", "E_INDETERMINATE").when((F.col("fault") == "error") & (F.col("latency_ms") > 40_000), "E_DEADLINE").when(F.col("fault") == "error", "E_EFFECT_FAILED")
    return T.deliveries(spark, sf).select("ns", "key", code.alias("code")).where("code IS NOT NULL").groupBy("ns", "key", "code").agg(F.count(F.lit(1)).alias("n"))


_FOLD = """commands AS (SELECT ns, key, row_number() OVER (PARTITION BY ns, key ORDER BY tick, kind, delivery_no) AS step, tick, op, delivery_no, fault FROM (
        SELECT ns, key, ts AS tick, 1 AS kind, 'claim' AS op, delivery_no, fault FROM deliveries UNION ALL
        SELECT ns, key, ts + latency_ms, 0, 'complete', delivery_no, fault FROM deliveries WHERE fault <> 'timeout')),
    folded AS (SELECT ns, key, 1::BIGINT AS step, 'in_flight' AS status, delivery_no AS owner, tick + 30000 AS lease_end, 0::BIGINT AS replays FROM commands WHERE step = 1
      UNION ALL SELECT c.ns, c.key, c.step,
        CASE WHEN op = 'claim' AND status = 'in_flight' AND lease_end < tick THEN 'indeterminate' WHEN op = 'complete' AND status = 'in_flight' AND owner = delivery_no THEN (CASE WHEN fault = 'ok' THEN 'succeeded' ELSE 'failed' END) ELSE status END,
        owner, lease_end, replays + CASE WHEN op = 'claim' AND status = 'succeeded' THEN 1 ELSE 0 END
      FROM folded f JOIN commands c ON c.ns = f.ns AND c.key = f.key AND c.step = f.step + 1)"""


@query(T.oracle("SELECT ns, key, arg_max(status, step) AS status, 1::BIGINT AS attempt, max(replays) AS replays FROM folded GROUP BY ns, key", "deliveries", more=_FOLD, recursive=True))
def effect_fold(spark, sf):
    return E.fold(T.deliveries(spark, sf))


@query(T.oracle("""SELECT circuit, n, count(*) FILTER (NOT ok) OVER w AS failures, count(*) OVER w AS samples FROM outcomes
    WINDOW w AS (PARTITION BY circuit ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "outcomes"))  # fmt: skip
def rolling_failure_ratio(spark, sf):
    return B.rolling_ratio(T.outcomes(spark, sf))


@query()
def circuit_events(spark, sf):
    """Every opening, probe and closing of the breakers."""
    return B.events(T.outcomes(spark, sf))


@query()
def circuit_fold(spark, sf):
    """State of each breaker: path-dependent, held against a plain loop in the tests."""
    out = B.fold(T.outcomes(spark, sf))
    return out.withColumn("window", F.array_join(F.transform("window", lambda x: x.cast("string")), ""))


@query()
def circuit_get(spark, sf):
    return circuit_fold(spark, sf).where("circuit = 'c3'")


@query(T.oracle("SELECT circuit, count(*) - count(*) // 7 AS version, count(*) - count(*) // 7 AS applied, count(*) // 7 AS refused FROM outcomes GROUP BY circuit", "outcomes"))
def circuit_cas(spark, sf):
    """Conditional writes in a row: each expects the version that the one before left, but every seventh an older one."""
    left = F.col("n") - 1 - F.floor((F.col("n") - 1) / 7)
    x = T.outcomes(spark, sf).select("circuit", "n", F.when(F.col("n") > 1, left - F.when(F.col("n") % 7 == 0, 1).otherwise(0)).alias("expected"))
    return B.compare_and_set(x)


@query(T.oracle("SELECT circuit, count(*) AS calls, count(*) FILTER (NOT ok) AS failures FROM outcomes GROUP BY circuit", "outcomes"))
def breaker_inputs(spark, sf):
    return T.outcomes(spark, sf).groupBy("circuit").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"))


_BUDGET = """steps AS (SELECT circuit, n, 0::BIGINT AS funded, 0::BIGINT AS denied, 30::BIGINT AS balance FROM (SELECT circuit, 0::BIGINT AS n FROM outcomes GROUP BY circuit)
    UNION ALL SELECT s.circuit, o.n, s.funded + least(CASE WHEN o.ok THEN 0 ELSE 2 END, least(100, s.balance + 1) // 10), s.denied + CASE WHEN least(100, s.balance + 1) // 10 < CASE WHEN o.ok THEN 0 ELSE 2 END THEN 1 ELSE 0 END,
      least(100, s.balance + 1) - 10 * least(CASE WHEN o.ok THEN 0 ELSE 2 END, least(100, s.balance + 1) // 10) FROM steps s JOIN outcomes o ON o.circuit = s.circuit AND o.n = s.n + 1)"""


@query(T.oracle("SELECT circuit, arg_max(balance, n) AS balance, max(funded) AS funded, max(denied) AS denied FROM steps GROUP BY circuit", "outcomes", more=_BUDGET, recursive=True))
def retry_budget(spark, sf):
    x = T.outcomes(spark, sf).select("circuit", "n", F.when(F.col("ok"), 0).otherwise(2).cast("long").alias("wanted"))
    return B.budget(x)


_TRIES = """tries AS (SELECT key, delivery_no AS n, fault, latency_ms // 10 AS latency, CASE WHEN qty % 5 = 0 THEN qty * 2000 END AS hint, least(3, max(delivery_no) OVER (PARTITION BY key)) AS most FROM deliveries),
    loop AS (SELECT DISTINCT key, 0::BIGINT AS n, 0::BIGINT AS clock, (key::BIGINT % 3) * 10 + 1 AS balance, NULL::VARCHAR AS status, NULL::VARCHAR AS code, false AS ended FROM tries
      UNION ALL SELECT l.key, t.n, CASE WHEN again THEN now + wait ELSE now END, l.balance - CASE WHEN again OR too_late THEN 10 ELSE 0 END,
        CASE WHEN late OR fault = 'timeout' THEN 'indeterminate' WHEN fault = 'ok' THEN 'succeeded' WHEN again THEN NULL ELSE 'failed' END,
        CASE WHEN late THEN 'E_DEADLINE' WHEN fault = 'ok' OR again THEN NULL WHEN fault = 'timeout' THEN 'E_INDETERMINATE' WHEN last OR far THEN 'E_EFFECT_FAILED' WHEN l.balance < 10 THEN 'E_RETRY_BUDGET' ELSE 'E_DEADLINE' END, NOT again
      FROM loop l JOIN tries t ON t.key = l.key AND t.n = l.n + 1,
        LATERAL (SELECT l.clock + t.latency >= 60000 AS late, least(l.clock + t.latency, 60000) AS now, t.n >= t.most AS last, coalesce(t.hint > 60000, false) AS far, coalesce(t.hint, (0.5 * least(10000, 200 * 2 ** t.n))::BIGINT) AS wait),
        LATERAL (SELECT NOT late AND fault = 'error' AND NOT last AND NOT far AND l.balance >= 10 AND now + wait > 60000 AS too_late, NOT late AND fault = 'error' AND NOT last AND NOT far AND l.balance >= 10 AND now + wait <= 60000 AS again)
      WHERE NOT l.ended)"""


@query(T.oracle("SELECT key, n::INTEGER AS attempts, clock AS ended_at, balance, status, code FROM loop WHERE ended", "deliveries", more=_TRIES, recursive=True))
def retry_loop(spark, sf):
    """Each key's deliveries as the attempts of one call, with hints, a thin budget and the deadline."""
    d = T.deliveries(spark, sf)
    kind = F.when(F.col("fault") == "ok", "ok").when(F.col("fault") == "error", "retryable").otherwise("indeterminate")
    one = F.struct(F.col("delivery_no").alias("n"), kind.alias("kind"), F.floor(F.col("latency_ms") / 10).cast("long").alias("latency"), F.when(F.col("qty") % 5 == 0, F.col("qty") * 2_000).alias("hint"), F.lit(0.5).alias("u"))
    calls = d.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("tries"))
    calls = calls.select("key", "tries", F.least(F.lit(3), F.size("tries")).alias("most"), (F.col("key").cast("long") % 3 * 10 + 1).alias("balance"))
    return RL.resolve(calls, "key").select("key", "attempts", F.col("at").alias("ended_at"), "balance", "status", "code")


@query(T.oracle("""SELECT ns, key, delivery_no, told AS code, told = 'E_STORE' AS retryable, told = 'E_INDETERMINATE' AS indeterminate FROM (SELECT d.ns, d.key, d.delivery_no, CASE w.fault WHEN 'error' THEN 'E_EFFECT_FAILED' WHEN 'timeout' THEN 'E_INDETERMINATE' END AS told
    FROM deliveries d JOIN win w USING (ns, key) WHERE d.delivery_no <> w.delivery_no)""", "deliveries", more=_WIN))  # fmt: skip
def error_flags(spark, sf):
    """What replayed callers are told, with what they may make of it."""
    x = E.replays(T.deliveries(spark, sf)).select("ns", "key", "delivery_no", F.when(F.col("told") != "replayed", F.col("told")).alias("code"))
    return x.select("*", X.retryable(F.col("code")).alias("retryable"), X.indeterminate(F.col("code")).alias("indeterminate"))


_LOG = """firsts AS (SELECT *, worker || ':' || delivery_no AS owner FROM deliveries),
    commands AS (SELECT ns, key, row_number() OVER (PARTITION BY ns, key ORDER BY tick, n) AS step, * EXCLUDE (ns, key) FROM (
        SELECT ns, key, delivery_no * 4 AS n, 'claim' AS op, ts AS tick, owner, fp, NULL AS ends FROM firsts UNION ALL
        SELECT ns, key, delivery_no * 4 + 1, 'heartbeat', ts + 10000, owner, fp, NULL FROM firsts WHERE latency_ms > 10000 UNION ALL
        SELECT ns, key, delivery_no * 4 + 2, 'complete', ts + latency_ms, owner, fp, CASE WHEN fault = 'ok' THEN 'succeeded' ELSE 'failed' END FROM firsts WHERE fault <> 'timeout')),
    state AS (SELECT ns, key, step, n, 'in_flight' AS status, 1::BIGINT AS attempt, owner AS holder, tick + 30000 AS lease_end, fp AS stored, 'claimed' AS outcome, NULL::VARCHAR AS code FROM commands WHERE step = 1
      UNION ALL SELECT ns, key, step, n,
        CASE WHEN parks THEN 'indeterminate' WHEN reclaims THEN 'in_flight' WHEN op = 'complete' AND held THEN ends ELSE status END,
        attempt + CASE WHEN reclaims THEN 1 ELSE 0 END,
        CASE WHEN parks OR (op = 'complete' AND held) THEN NULL WHEN reclaims THEN owner ELSE holder END,
        CASE WHEN parks OR (op = 'complete' AND held) THEN NULL WHEN reclaims OR (op = 'heartbeat' AND held) THEN tick + 30000 ELSE lease_end END, stored,
        CASE WHEN op = 'claim' THEN (CASE WHEN reclaims THEN 'claimed' ELSE 'exists' END) WHEN op = 'heartbeat' THEN (CASE WHEN held THEN 'ok' ELSE 'not_ok' END) ELSE (CASE WHEN held THEN 'ok' ELSE 'refused' END) END,
        CASE WHEN op = 'complete' AND NOT held THEN 'E_LEASE_LOST' WHEN op = 'claim' AND stored <> fp THEN 'E_KEY_CONFLICT' END
      FROM (SELECT s.ns, s.key, c.step, c.n, c.op, c.owner, c.fp, c.ends, c.tick, s.status, s.attempt, s.holder, s.lease_end, s.stored, coalesce(s.status = 'in_flight' AND s.holder = c.owner, false) AS held,
          coalesce(c.op = 'claim' AND s.status = 'in_flight' AND s.lease_end < c.tick, false) AS parks, c.op = 'claim' AND s.status = 'indeterminate' AND c.key::BIGINT % 3 = 0 AS reclaims
        FROM state s JOIN commands c ON c.ns = s.ns AND c.key = s.key AND c.step = s.step + 1))"""


@query(T.oracle("SELECT ns, key, arg_max(status, step) AS status, max(attempt) AS attempt, max(struct_pack(step := step, e := lease_end)).e AS lease_end FROM state GROUP BY ns, key", "deliveries", more=_LOG, recursive=True))
def effect_commands(spark, sf):
    """The record of every key after claims, heartbeats, completions and reclaims."""
    return C.records(C.from_deliveries(T.deliveries(spark, sf)), clustered=True, fixed=C.DELIVERED).select("ns", "key", "status", "attempt", "lease_end")


@query(T.oracle("SELECT ns, key, n, outcome, code FROM state", "deliveries", more=_LOG, recursive=True))
def command_answers(spark, sf):
    """What every command is told."""
    return C.answers(C.from_deliveries(T.deliveries(spark, sf)), clustered=True, fixed=C.DELIVERED).select("ns", "key", "n", "outcome", "code")
