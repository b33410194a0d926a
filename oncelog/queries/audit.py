"""Queries on the audit log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import invariants as I
from ..sources import tables as T
from .registry import query

_PAYLOAD = """'{"actor":' || to_json(actor)::VARCHAR || ',"attempt":' || coalesce(attempt::VARCHAR, 'null') || ',"data":' || data || ',"namespace":' || to_json(ns)::VARCHAR || ',"subjectKey":' || to_json(subject_key)::VARCHAR
    || ',"subjectType":' || to_json(subject_type)::VARCHAR || ',"ts":' || ts || ',"type":' || to_json(type)::VARCHAR || '}'"""
_SEQ = f"seqd AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY ts, event_id) AS seq, {_PAYLOAD} AS payload FROM audit)"
_CHAIN = f"""{_SEQ}, chain AS (SELECT ns, event_id, seq, ts, payload, NULL::VARCHAR AS prev_hash, sha256(payload) AS hash FROM seqd WHERE seq = 1
    UNION ALL SELECT s.ns, s.event_id, s.seq, s.ts, s.payload, c.hash, sha256(c.hash || s.payload) FROM chain c JOIN seqd s ON s.ns = c.ns AND s.seq = c.seq + 1)"""


@query(T.oracle("SELECT ns, event_id, seq FROM seqd", "audit", more=_SEQ))
def audit_seq(spark, sf):
    return A.sequence(T.audit_log(spark, sf)).select("ns", "event_id", "seq")


@query(T.oracle("SELECT event_id, payload FROM seqd", "audit", more=_SEQ))
def event_payload(spark, sf):
    return T.audit_log(spark, sf).select("event_id", A.payload().alias("payload"))


@query(T.oracle("SELECT 'evt_' || ns || '_' || seq AS id, ns, seq, prev_hash, hash FROM chain", "audit", more=_CHAIN, recursive=True))
def audit_append_chain(spark, sf):
    c = A.chain(T.audit_log(spark, sf))
    return c.select(F.concat(F.lit("evt_"), "ns", F.lit("_"), F.col("seq").cast("string")).alias("id"), "ns", "seq", "prev_hash", "hash")


@query(T.oracle("SELECT ns, max(seq) AS seq, arg_max(hash, seq) AS head_hash FROM chain GROUP BY ns", "audit", more=_CHAIN, recursive=True))
def chain_head(spark, sf):
    return A.heads(T.audit_log(spark, sf))


@query(T.oracle("SELECT ns, true AS ok, NULL::BIGINT AS broken_at, count(*) AS checked FROM seqd GROUP BY ns", "audit", more=_SEQ))
def chain_verify(spark, sf):
    return A.verify(A.chain(T.audit_log(spark, sf)))


@query(T.oracle("SELECT ns, count(*) < 5 AS ok, CASE WHEN count(*) >= 5 THEN 4::BIGINT END AS broken_at, least(count(*), 4)::BIGINT AS checked FROM seqd GROUP BY ns", "audit", more=_SEQ))
def chain_tamper(spark, sf):
    """Chains with the content of their fifth event altered: found at that row."""
    c = A.chain(T.audit_log(spark, sf))
    forged = F.when(F.col("seq") == 5, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return A.verify(c.withColumn("payload", forged))


@query(T.oracle("SELECT ns, event_id, seq, ts FROM seqd WHERE ns = 'error' AND seq > 40 ORDER BY seq LIMIT 100", "audit", more=_SEQ))
def audit_since(spark, sf):
    return A.since(A.sequence(T.audit_log(spark, sf)), "error", 40).select("ns", "event_id", "seq", "ts")


@query(T.oracle("SELECT ns, event_id, seq, (seq - 1) // 500 AS page FROM seqd", "audit", more=_SEQ))
def audit_export(spark, sf):
    return A.pages(A.sequence(T.audit_log(spark, sf))).select("ns", "event_id", "seq", "page")


@query(T.oracle("SELECT subject_key, row_number() OVER (PARTITION BY subject_key ORDER BY ts, event_id) AS place, type FROM audit", "audit"))
def event_trace(spark, sf):
    """Each subject's events in order, a row for each: a subject may have any number."""
    w = Window.partitionBy("subject_key").orderBy("ts", "event_id")
    return T.audit_log(spark, sf).select("subject_key", F.row_number().over(w).cast("long").alias("place"), "type")


@query(T.oracle("SELECT subject_key, count(*) AS published FROM audit WHERE type = 'effect.succeeded' GROUP BY subject_key", "audit"))
def publish_count(spark, sf):
    return T.audit_log(spark, sf).where("type = 'effect.succeeded'").groupBy("subject_key").agg(F.count(F.lit(1)).alias("published"))


_TERMINAL = """effects AS (SELECT ns, subject_key AS key, CASE WHEN event_id % 7 = 0 THEN 'indeterminate' ELSE split_part(type, '.', 2) END AS status FROM audit)"""


@query(T.oracle("SELECT ns, key, status FROM effects e WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.subject_key = e.key AND split_part(a.type, '.', 2) = e.status)", "audit", more=_TERMINAL))
def i7_completeness(spark, sf):
    """Terminal effects without an event of that end: every seventh is planted."""
    log = T.audit_log(spark, sf)
    e = log.select("ns", F.col("subject_key").alias("key"), F.when(F.col("event_id") % 7 == 0, "indeterminate").otherwise(F.substring_index("type", ".", -1)).alias("status"))
    return I.completeness(e, log)
