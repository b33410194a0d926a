"""Queries on approval gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gates as G
from ..operators import invariants as I
from ..sources import tables as T
from .registry import query

_NOW = 820_000_000_000
_RANKED = """ranked AS (SELECT d.*, g.ns, g.created_at, g.expires_at, g.on_timeout, row_number() OVER (PARTITION BY d.id ORDER BY d.ts, d.decision_no) AS rn FROM decisions d JOIN gates g USING (id) WHERE d.ts >= g.created_at)"""
_STATES = f"""{_RANKED}, won AS (SELECT id, ts, decision, actor FROM ranked WHERE rn = 1 AND ts < expires_at AND ts <= {_NOW}),
    states AS (SELECT g.*, coalesce(w.decision, CASE WHEN expires_at <= {_NOW} THEN (CASE WHEN on_timeout = 'approve' THEN 'approved' ELSE 'timed_out' END) END, 'pending') AS status,
        coalesce(w.ts, CASE WHEN expires_at <= {_NOW} THEN expires_at END) AS decided_at, coalesce(w.actor, CASE WHEN expires_at <= {_NOW} THEN 'engine:timeout' END) AS decided_by FROM gates g LEFT JOIN won w USING (id))"""


def _states(spark, sf):
    return G.resolve(T.gates(spark, sf), T.decisions(spark, sf), F.lit(_NOW))


_ALL = ("gates", "decisions")


@query(T.oracle("SELECT * FROM states WHERE id = 'gate-7'", *_ALL, more=_STATES))
def gate_get(spark, sf):
    return _states(spark, sf).where("id = 'gate-7'")


@query(T.oracle("SELECT * FROM states WHERE ns = 'ns3' AND key = '3'", *_ALL, more=_STATES))
def gate_by_key(spark, sf):
    return _states(spark, sf).where("ns = 'ns3' AND key = '3'")


@query(T.oracle("SELECT id, status, created_at FROM states WHERE ns = 'ns2' AND status = 'approved' ORDER BY created_at, id LIMIT 100", *_ALL, more=_STATES))
def gate_list(spark, sf):
    return G.listed(_states(spark, sf), "ns2", "approved").select("id", "status", "created_at")


@query(T.oracle("SELECT id, created_at FROM states WHERE status IN ('approved', 'rejected', 'timed_out') ORDER BY created_at, id LIMIT 10", *_ALL, more=_STATES))
def gates_claimable(spark, sf):
    return G.claimable(_states(spark, sf)).select("id", "created_at")


@query(T.oracle("SELECT id, ns, key, created_at, expires_at FROM (SELECT *, row_number() OVER (PARTITION BY ns, created_at // 864000000 ORDER BY created_at, id) AS rn FROM gates) WHERE rn = 1", "gates"))
def gate_open(spark, sf):
    """Requests that share a key within ten days get the gate of the first."""
    g = T.gates(spark, sf)
    x = g.withColumn("own", F.col("key")).withColumn("key", F.expr("created_at div 864000000").cast("string"))
    return G.open_gates(x).select("id", "ns", F.col("own").alias("key"), "created_at", "expires_at")


@query(T.oracle("SELECT id, decision, ts AS decided_at, actor FROM ranked WHERE rn = 1 AND ts < expires_at", *_ALL, more=_RANKED))
def gate_decisions(spark, sf):
    return G.ranked_decisions(T.gates(spark, sf), T.decisions(spark, sf)).where("applied").select("id", "decision", F.col("ts").alias("decided_at"), "actor")


@query(T.oracle("SELECT id, decision_no, ts, decision, rn = 1 AND ts < expires_at AS applied FROM ranked", *_ALL, more=_RANKED))
def gate_decision_audit(spark, sf):
    return G.ranked_decisions(T.gates(spark, sf), T.decisions(spark, sf)).select("id", "decision_no", "ts", "decision", "applied")


@query(T.oracle("SELECT id, status, decided_at FROM states WHERE decided_by = 'engine:timeout'", *_ALL, more=_STATES))
def gate_timeouts(spark, sf):
    return _states(spark, sf).where("decided_by = 'engine:timeout'").select("id", "status", "decided_at")


@query(T.oracle("SELECT id, created_at FROM states WHERE ns = 'ns0' AND status = 'pending'", *_ALL, more=_STATES))
def gate_pending(spark, sf):
    return _states(spark, sf).where("ns = 'ns0' AND status = 'pending'").select("id", "created_at")


@query(T.oracle("SELECT id, CASE status WHEN 'approved' THEN 'returned' WHEN 'timed_out' THEN 'E_GATE_TIMEOUT' WHEN 'pending' THEN 'E_WAIT_TIMEOUT' ELSE 'E_GATE_REJECTED' END AS outcome FROM states", *_ALL, more=_STATES))
def gate_outcomes(spark, sf):
    o = F.when(F.col("status") == "approved", "returned").when(F.col("status") == "timed_out", "E_GATE_TIMEOUT").when(F.col("status") == "pending", "E_WAIT_TIMEOUT").otherwise("E_GATE_REJECTED")
    return _states(spark, sf).select("id", o.alias("outcome"))


@query(T.oracle("SELECT ns, count(*) AS total, count(*) FILTER (status <> 'pending') AS terminal FROM states GROUP BY ns", *_ALL, more=_STATES))
def gate_counts(spark, sf):
    return _states(spark, sf).groupBy("ns").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "pending").alias("terminal"))


@query(T.oracle("SELECT s.id, s.status, w.delivery_no AS resumed_by FROM states s JOIN win w ON w.key = s.key WHERE s.status = 'approved' AND w.ts >= s.decided_at", *_ALL,
    more=_STATES + ", win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ns, key ORDER BY ts DESC, delivery_no DESC) AS rn FROM deliveries) WHERE rn = 1)"))
def gate_resume(spark, sf):
    """Approved gates whose last delivery came after the decision and ran the resumed work."""
    from pyspark.sql import Window

    w = Window.partitionBy("ns", "key").orderBy(F.desc("ts"), F.desc("delivery_no"))
    last = T.deliveries(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("key", "ts", "delivery_no")
    return _states(spark, sf).where("status = 'approved'").join(last, "key").where("ts >= decided_at").select("id", "status", F.col("delivery_no").alias("resumed_by"))


_GRID: list[float] = [0.0]
_delay = 1_000.0
for _ in range(40):
    _GRID.append(_GRID[-1] + _delay)
    _delay = min(60_000.0, _delay * 1.5)
_LAST = _GRID[-1]


@query(T.oracle(f"""SELECT id, created_at + coalesce(list_min(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in _GRID)}], lambda o: o >= decided_at - created_at)), {_LAST!r} + ceil((decided_at - created_at - {_LAST!r}) / 60000.0) * 60000.0) AS observed_at
    FROM states WHERE status = 'approved'""", *_ALL, more=_STATES))  # fmt: skip
def gate_wait(spark, sf):
    x = _states(spark, sf).where("status = 'approved'")
    return x.select("id", G.poll_observation(F.col("created_at"), F.col("decided_at")).alias("observed_at"))


_HELD = """claims AS (SELECT 'gate-' || key AS id, ts, worker AS owner, CASE WHEN fault = 'ok' THEN 'ack' ELSE 'claim' END AS op FROM deliveries),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, owner, op) AS step FROM claims),
    held AS (SELECT DISTINCT id, 0::BIGINT AS step, NULL::VARCHAR AS owner, NULL::BIGINT AS until, NULL::BIGINT AS processed_at, 0::BIGINT AS claims FROM claims
      UNION ALL SELECT h.id, c.step, CASE WHEN takes THEN c.owner ELSE h.owner END, CASE WHEN takes THEN c.ts + 30000 ELSE h.until END, CASE WHEN acks THEN c.ts ELSE h.processed_at END, h.claims + CASE WHEN takes THEN 1 ELSE 0 END
      FROM held h JOIN ordered c ON c.id = h.id AND c.step = h.step + 1,
        LATERAL (SELECT c.op = 'claim' AND h.processed_at IS NULL AND (h.owner IS NULL OR h.until < c.ts) AS takes, coalesce(c.op = 'ack' AND h.processed_at IS NULL AND h.owner = c.owner, false) AS acks)),
    lives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step DESC) AS rn FROM held) WHERE rn = 1)"""


def _claims(spark, sf):
    op = F.when(F.col("fault") == "ok", "ack").otherwise("claim")
    return T.deliveries(spark, sf).select(F.concat(F.lit("gate-"), "key").alias("id"), "ts", F.col("worker").alias("owner"), op.alias("op"))


@query(T.oracle("SELECT id, owner, processed_at, claims FROM lives", "deliveries", more=_HELD, recursive=True))
def gate_lifecycle(spark, sf):
    """Claims and acks of workers on each gate, folded."""
    return G.lifecycle(_claims(spark, sf)).select("id", "owner", "processed_at", "claims")


_AT = 800_000_000_000


@query(T.oracle(f"""SELECT id, created_at FROM states s WHERE status IN ('approved', 'rejected', 'timed_out')
    AND NOT EXISTS (SELECT 1 FROM lives l WHERE l.id = s.id AND (l.processed_at IS NOT NULL OR l.until >= {_AT})) ORDER BY created_at, id LIMIT 10""", *_ALL, more=_STATES + ", " + _HELD.replace("FROM deliveries)", f"FROM deliveries WHERE ts <= {_AT})", 1), recursive=True))  # fmt: skip
def gates_unheld(spark, sf):
    """Decided gates that a worker can claim now: not held under a lease in force, not done with."""
    return G.claimable(_states(spark, sf), claims=_claims(spark, sf), now=F.lit(_AT)).select("id", "created_at")


@query(T.oracle("SELECT id, CASE WHEN decided_at IS NULL OR decided_at > created_at + 864000000.0 THEN created_at + 864000000.0::DOUBLE END AS gave_up_at, CASE WHEN decided_at IS NULL OR decided_at > created_at + 864000000.0 THEN 'E_WAIT_TIMEOUT' END AS code FROM states", *_ALL, more=_STATES))
def gate_wait_limit(spark, sf):
    """Waiters of ten days: which give up, and when."""
    x = G.waits(_states(spark, sf).select("id", "created_at", "decided_at"), F.col("created_at"), 864_000_000)
    return x.select("id", F.when(F.col("code").isNotNull(), F.col("observed_at")).alias("gave_up_at"), "code")


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 32768 THEN 'E_RESULT_TOO_LARGE' END AS code FROM documents")
def gate_context_size(spark, sf):
    """Resume contexts beyond 32 KiB are refused when a gate is opened."""
    return T.read(spark, sf, "documents").select("doc_id", F.when(F.octet_length("text") > S.MAX_CONTEXT_BYTES, "E_RESULT_TOO_LARGE").alias("code"))


@query(T.oracle("SELECT id, status, decided_at, expires_at FROM states WHERE status = 'pending' OR decided_at > expires_at + 1000", *_ALL, more=_STATES))
def i4_gate_liveness(spark, sf):
    return I.gate_liveness(_states(spark, sf))


@query()
def hmac_token(spark, sf):
    """Tokens of gates: minted, verified at once, after expiry, for another gate and with another secret."""
    g = T.gates(spark, sf).select("id", "expires_at", "created_at")
    x = g.withColumn("token", S.mint_token(F.col("id"), F.col("expires_at"), F.sha2("id", 256).substr(1, 16), F.lit("secret")))
    ok = lambda gate, now, secret="secret": S.token_is_valid(F.col("token"), F.lit(secret), gate, now)
    return x.select(
        "id", "token", ok(F.col("id"), F.col("created_at")).alias("valid"), ok(F.col("id"), F.col("expires_at") + 1).alias("late"),
        S.token_code(F.col("token"), F.lit("secret"), F.col("id"), F.col("expires_at") + 1).alias("late_code"), ok(F.lit("gate-0"), F.col("created_at")).alias("other_gate"), ok(F.col("id"), F.col("created_at"), "guess").alias("other_secret"),
    )
