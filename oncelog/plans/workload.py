"""Seeded workloads: intents, deliveries, attempts and what a naive and a deduplicating client make of them.

Every fault is a pure draw from (seed, label), so a workload of any size is a projection
over ``spark.range`` and needs no shuffle; only clients whose calls share a breaker are
folded, one group for each (seed, worker): see ``storm``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import faults
from ..functions import scalars as S
from . import scenarios, storm

SEEDS = 10
BASELINE = {"intents": 20, "deliveries": (2, 5), "error": 0.15, "timeout": 0.15, "attempts": 3}


def intents(spark: SparkSession, seeds: int, per_seed: int) -> DataFrame:
    """seed, i, intent."""
    r = spark.range(seeds * per_seed)
    return r.select((F.expr(f"id div {per_seed}") + 1).cast("int").alias("seed"), (F.col("id") % per_seed).cast("int").alias("i"), F.concat(F.lit("intent-"), (F.col("id") % per_seed).cast("string")).alias("intent"))


def fan_out(work: DataFrame, low: int, high: int) -> DataFrame:
    """One row for each delivery, on alternating workers."""
    n = faults.deliveries_for(F.col("seed"), F.col("intent"), low, high)
    x = work.withColumn("d", n).select("*", F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("k"))
    return x.withColumn("worker", F.when(F.col("k") % 2 == 0, "w1").otherwise("w2"))


def fault_table(work: DataFrame, attempts: int, error: float, timeout: float) -> DataFrame:
    """seed, intent, attempt, fault: one row for each attempt that a plan has a fault for."""
    x = work.select("*", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    return x.withColumn("fault", faults.attempt_fault(F.col("seed"), F.col("intent"), F.col("attempt"), error, timeout))


def _fault_lists(work: DataFrame, attempts: int, error: float, timeout: float) -> DataFrame:
    listed = F.transform(F.sequence(F.lit(1), F.lit(attempts)), lambda a: faults.attempt_fault(F.col("seed"), F.col("intent"), a, error, timeout))
    return work.withColumn("faults", listed)


def naive(work: DataFrame, low: int, high: int, error: float, timeout: float) -> DataFrame:
    """seed, intent, deliveries, attempts, landed, succeeded of a client that retries whatever failed.

    Attempts are numbered per intent; a round holds the failures of the round before it.
    """
    x = _fault_lists(work.withColumn("d", faults.deliveries_for(F.col("seed"), F.col("intent"), low, high)), 3 * high, error, timeout)
    bad = lambda a, n: F.size(F.filter(F.slice("faults", a + 1, n), lambda f: f != "ok"))
    x = x.withColumn("f1", bad(F.lit(0), F.col("d")))
    x = x.withColumn("f2", bad(F.col("d"), F.col("f1")))
    used = F.slice("faults", 1, F.col("d") + F.col("f1") + F.col("f2"))
    return x.select(
        "seed", "intent", F.col("d").cast("long").alias("deliveries"), F.size(used).cast("long").alias("attempts"),
        F.size(F.filter(used, lambda f: f != "error")).cast("long").alias("landed"), F.exists(used, lambda f: f == "ok").alias("succeeded"),
    )


def resolution(work: DataFrame, error: float, timeout: float, attempts: int = S.RETRY_ATTEMPTS) -> DataFrame:
    """seed, intent, attempts, status, landed of the retry loop of one delivery whose retries are all funded."""
    x = _fault_lists(work, attempts, error, timeout)
    last = F.coalesce(F.get(F.filter(F.sequence(F.lit(1), F.lit(attempts)), lambda a: F.get("faults", a - 1) != "error"), 0), F.lit(attempts))
    x = x.withColumn("n", last).withColumn("fault", F.get("faults", F.col("n") - 1))
    status = F.when(F.col("fault") == "ok", "succeeded").when(F.col("fault") == "timeout", "indeterminate").otherwise("failed")
    return x.select("seed", "intent", F.col("n").cast("long").alias("attempts"), status.alias("status"), (F.col("fault") != "error").cast("long").alias("landed"))


def playground_high(rate: Column) -> Column:
    return (1 + F.greatest(F.lit(1), F.floor(4 * rate + 0.5))).cast("int")


def client(work: DataFrame, error: float, timeout: float = 0.0, breaker: bool = True) -> DataFrame:
    """seed, intent, attempts, landed, code of calls of one worker, which share a retry budget and, if any, a breaker."""
    x = _fault_lists(work, S.RETRY_ATTEMPTS, error, timeout)
    x = x.withColumns({"case": F.col("seed").cast("string"), "tries": F.lit(S.RETRY_ATTEMPTS), "latencies": F.array_repeat(F.lit(0).cast("bigint"), S.RETRY_ATTEMPTS)})
    return storm.calls(x, breaker).select("seed", F.concat(F.lit("intent-"), F.col("i").cast("string")).alias("intent"), "attempts", "landed", "code")


def of_runs(played: DataFrame) -> DataFrame:
    """scenario, seed, intent, deliveries, attempts, landed, status of played intents; a gate without an effect tells its own state."""
    status = F.coalesce("status", F.when(F.col("effect_key").isNull(), F.col("gate")), F.lit("none"))
    return played.select("scenario", "seed", "intent", "deliveries", "attempts", "landed", status.alias("status"))


def scenario(spark: SparkSession, name: str, seeds: int = SEEDS) -> DataFrame:
    return of_runs(scenarios.play(scenarios.defaults(spark, seeds, [name])))


def all_scenarios(spark: SparkSession, seeds: int = SEEDS) -> DataFrame:
    return of_runs(scenarios.play(scenarios.defaults(spark, seeds)))


def as_runs(landings: DataFrame) -> DataFrame:
    """Landings of a client without a store (seed, intent, deliveries, attempts, landed, succeeded) in the form of runs."""
    x = landings.select(F.col("seed").cast("string").alias("case"), "intent", "deliveries", "attempts", "landed", F.col("succeeded").cast("bigint").alias("reported"), F.when(F.col("succeeded"), "succeeded").otherwise("failed").alias("status"))
    none = {"scenario": "string", "gate": "string", "parked_at": "bigint", "called_at": "bigint", "reclaimed": "boolean", "expires_at": "bigint", "decided_at": "bigint"}
    told = F.array(F.lit("effect.claimed"), F.concat(F.lit("effect."), "status"))
    return x.withColumns({name: F.lit(None).cast(kind) for name, kind in none.items()} | {"replays": F.lit(0).cast("bigint"), "events": told, "scenario": F.lit("naive")})


def rollup(rows: DataFrame) -> DataFrame:
    """Totals of each scenario and of all (scenario null)."""
    return rows.rollup("scenario").agg(
        F.count(F.lit(1)).alias("intents"), F.sum("deliveries").alias("deliveries"), F.sum("landed").alias("ledger"), F.sum("attempts").alias("attempts"),
        F.sum(F.greatest(F.lit(0), F.col("landed") - 1)).cast("long").alias("duplicates"),
    )
