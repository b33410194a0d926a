"""Approval gates: opened once, decided once, resolved by time if nobody decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def open_gates(requests: DataFrame) -> DataFrame:
    """The gate of each (ns, key): the first request opens it, later ones get it back."""
    w = Window.partitionBy("ns", "key").orderBy("created_at", "id")
    return requests.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def listed(gates: DataFrame, ns: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """Gates by the predicates that are given, oldest first."""
    for name, value in (("ns", ns), ("status", status)):
        if value is not None:
            gates = gates.where(F.col(name) == value)
    return gates.orderBy("created_at", "id").limit(limit)


def ranked_decisions(gates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every decision with the gate's times and whether it applied: the first one, before the gate expires."""
    x = decisions.join(gates.select("id", "ns", "created_at", "expires_at", "on_timeout"), "id").where("ts >= created_at")
    rn = F.row_number().over(Window.partitionBy("id").orderBy("ts", "decision_no"))
    return x.withColumn("rn", rn).withColumn("applied", (F.col("rn") == 1) & (F.col("ts") < F.col("expires_at")))


def resolve(gates: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The state of every gate at ``now``: decided, timed out at its expiry, or pending."""
    won = ranked_decisions(gates, decisions).where(F.col("applied") & (F.col("ts") <= now)).select("id", "ts", "decision", "actor")
    x = gates.join(won, "id", "left")
    timed = F.when(F.col("on_timeout") == "approve", "approved").otherwise("timed_out")
    over = F.col("expires_at") <= now
    return x.select(
        "id", "ns", "key", "created_at", "expires_at", "on_timeout",
        F.coalesce("decision", F.when(over, timed), F.lit("pending")).alias("status"),
        F.coalesce("ts", F.when(over, F.col("expires_at"))).alias("decided_at"),
        F.coalesce("actor", F.when(over, F.lit("engine:timeout"))).alias("decided_by"),
    )


def claimable(states: DataFrame, limit: int = S.CLAIM_LIMIT, claims: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Decided gates that nobody holds at ``now``, oldest first; cancelled ones are never handed out.

    With claims and acks (id, ts, owner, op) so far, gates that are held under a lease in
    force, or done with, are left out.
    """
    free = states.where(F.col("status").isin("approved", "rejected", "timed_out"))
    if claims is not None:
        held = lifecycle(claims.where(F.col("ts") <= now)).where(F.col("processed_at").isNotNull() | (F.col("until") >= now))
        free = free.join(held.select("id"), "id", "left_anti")
    return free.orderBy("created_at", "id").limit(limit)


def poll_observation(start: Column, at: Column, steps: int = 40) -> Column:
    """The first point of the growing poll grid that is not before ``at``.

    Intervals are 1 s, then 1.5 times the last, at most 60 s: closed form behind the
    steps after which they stay equal.
    """
    offsets, delay = [0.0], float(S.GATE_POLL_MS)
    for _ in range(steps):
        offsets.append(offsets[-1] + delay)
        delay = min(float(S.GATE_POLL_CAP_MS), delay * S.GATE_POLL_FACTOR)
    grid = F.array(*(F.lit(o) for o in offsets))
    gap = (at - start).cast("double")
    beyond = offsets[-1] + F.ceil((gap - offsets[-1]) / S.GATE_POLL_CAP_MS) * S.GATE_POLL_CAP_MS
    return start + F.coalesce(F.get(F.filter(grid, lambda o: o >= gap), 0), beyond)


def waits(states: DataFrame, start: Column, max_wait_ms: int) -> DataFrame:
    """id, observed_at, code: when a waiter sees each gate's end, or gives up at ``max_wait_ms`` (its last look)."""
    limit = start + float(max_wait_ms)
    seen = F.least(poll_observation(start, F.greatest(F.coalesce("decided_at", start), start)), limit)
    over = F.col("decided_at").isNull() | (F.col("decided_at") > limit)
    return states.select("id", F.when(over, limit).otherwise(seen).alias("observed_at"), F.when(over, "E_WAIT_TIMEOUT").alias("code"))


def lifecycle(claims: DataFrame) -> DataFrame:
    """Folds (id, ts, owner, op) of claims and acks into holder and processed_at of each gate.

    A claim holds while its lease lasts (free once its end is strictly before the next
    claim); an ack counts from the holder alone, also after the lease's end.
    """
    log = claims.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "owner", "op"))).alias("log"))
    start = F.struct(F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("until"), F.lit(None).cast("long").alias("processed_at"), F.lit(0).cast("long").alias("claims"))

    def step(s: Column, c: Column) -> Column:
        free = s["processed_at"].isNull() & (s["owner"].isNull() | (s["until"] < c["ts"]))
        taken = F.struct(c["owner"].alias("owner"), (c["ts"] + S.CLAIM_LEASE_MS).alias("until"), s["processed_at"].alias("processed_at"), (s["claims"] + 1).alias("claims"))
        done = F.struct(s["owner"].alias("owner"), s["until"].alias("until"), c["ts"].alias("processed_at"), s["claims"].alias("claims"))
        acks = (c["op"] == "ack") & s["processed_at"].isNull() & (s["owner"] == c["owner"])
        return F.when((c["op"] == "claim") & free, taken).when(acks, done).otherwise(s)

    return log.select("id", F.aggregate("log", start, step).alias("s")).select("id", "s.owner", "s.until", "s.processed_at", "s.claims")
