"""Integrity queries: each returns the rows that break an invariant, none on good data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exactly_once(intents: DataFrame, counts: DataFrame, successes: DataFrame) -> DataFrame:
    """Intents that landed more than once, or that were reported as done and did not land once."""
    x = intents.select("key").join(counts.select("key", "n"), "key", "left").join(successes.select("key", "reported"), "key", "left")
    n, reported = F.coalesce("n", F.lit(0)), F.coalesce("reported", F.lit(0))
    return x.where((n > 1) | ((reported > 0) & (n != 1))).select("key", n.cast("long").alias("n"), reported.cast("long").alias("reported"))


def phantom_success(successes: DataFrame, entries: DataFrame) -> DataFrame:
    return successes.where("reported > 0").join(entries.select("key").distinct(), "key", "left_anti").select("key", "reported")


def fail_closed(parked: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts strictly after the moment that their effect was parked."""
    return attempts.join(parked.select("key", "parked_at"), "key").where("ts > parked_at").select("key", "delivery_no", "parked_at", "ts")


def gate_liveness(states: DataFrame, slack_ms: int = 1_000) -> DataFrame:
    """Gates that are undecided, or were decided later than their expiry allows."""
    return states.where((F.col("status") == "pending") | (F.col("decided_at") > F.col("expires_at") + slack_ms)).select("id", "status", "decided_at", "expires_at")


def resumed_once(resumes: DataFrame, counts: DataFrame) -> DataFrame:
    x = resumes.select("key").distinct().join(counts.select("key", "n"), "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return x.where("n <> 1")


def amplification(attempts: DataFrame, intents: DataFrame, *groups: str, gate: float = 1.5) -> DataFrame:
    """Groups whose attempts per intent pass the gate."""
    a = attempts.groupBy(*groups).agg(F.count(F.lit(1)).alias("attempts"))
    i = intents.groupBy(*groups).agg(F.count(F.lit(1)).alias("intents"))
    return i.join(a, [*groups], "left").select(*groups, "intents", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts")).where(F.col("attempts") > gate * F.col("intents"))


def completeness(effects: DataFrame, events: DataFrame) -> DataFrame:
    """Terminal effects without their terminal event."""
    told = events.select(F.col("subject_key").alias("key"), F.substring_index("type", ".", -1).alias("status")).distinct()
    return effects.where(F.col("status").isin("succeeded", "failed", "indeterminate")).join(told, ["key", "status"], "left_anti").select("ns", "key", "status")


def monotonic(transitions: DataFrame) -> DataFrame:
    """Transitions out of a terminal state; only a reclaim may leave ``indeterminate``."""
    w = Window.partitionBy("key").orderBy("n")
    x = transitions.withColumn("before", F.lag("status").over(w))
    bad = F.col("before").isin("succeeded", "failed") & (F.col("status") != F.col("before")) | ((F.col("before") == "indeterminate") & ~F.col("status").isin("indeterminate", "in_flight"))
    return x.where(bad).select("key", "n", "before", "status")
