"""Effects: one outcome for each (ns, key), however often it is delivered.

First-row-per-key questions are windows that Spark can cut down before a shuffle
(``row_number() = 1``); states that depend on a whole history are folds over the sorted
commands of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

KEY = ("ns", "key")


def _first():  # type: ignore[no-untyped-def]
    return Window.partitionBy(*KEY).orderBy("ts", "delivery_no")


def inspect(effects: DataFrame, ns: str, key: str) -> DataFrame:
    return effects.where((F.col("ns") == ns) & (F.col("key") == key))


def claim_winners(deliveries: DataFrame) -> DataFrame:
    """The delivery that executes each effect."""
    return deliveries.withColumn("rn", F.row_number().over(_first())).where("rn = 1").drop("rn")


def collapse(deliveries: DataFrame) -> DataFrame:
    """executed or replayed for every delivery; replays carry when their effect was first seen."""
    status = F.when(F.row_number().over(_first()) == 1, "executed").otherwise("replayed")
    return deliveries.select("ns", "key", "delivery_no", status.alias("status"), F.min("ts").over(Window.partitionBy(*KEY)).alias("first_seen_at"))


def replays(deliveries: DataFrame) -> DataFrame:
    """What each later delivery is told: the winner's stored outcome."""
    win = claim_winners(deliveries).select("ns", "key", F.col("delivery_no").alias("winner"), F.col("fault").alias("winner_fault"))
    told = F.when(F.col("winner_fault") == "ok", "replayed").when(F.col("winner_fault") == "error", "E_EFFECT_FAILED").otherwise("E_INDETERMINATE")
    return deliveries.join(win, [*KEY]).where("delivery_no <> winner").select("ns", "key", "delivery_no", "winner", told.alias("told"))


def key_conflicts(deliveries: DataFrame) -> DataFrame:
    """Deliveries whose fingerprint differs from the one stored with the effect; null compares with nothing."""
    stored = F.first("fp").over(_first().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return deliveries.withColumn("stored", stored).where("fp <> stored").select("ns", "key", "delivery_no", F.col("stored").alias("expected"), F.col("fp").alias("got"))


def lease_ends(deliveries: DataFrame, lease_ms: int = S.LEASE_MS) -> DataFrame:
    """When the lease of each delivery's execution ends: heartbeats extend it at a third of its length."""
    beat = max(1, lease_ms // 3)
    beats = F.expr(f"latency_ms div {beat}")
    return deliveries.select("ns", "key", "delivery_no", beats.alias("beats"), (F.col("ts") + beats * beat + lease_ms).alias("lease_end"))


def lease_expiries(deliveries: DataFrame, lease_ms: int = S.LEASE_MS) -> DataFrame:
    """Executions that never completed and whose lease the next claim finds expired (strictly before it)."""
    ahead = deliveries.withColumn("next_claim", F.lead("ts").over(_first())).withColumn("rn", F.row_number().over(_first()))
    return ahead.where((F.col("rn") == 1) & (F.col("fault") == "timeout") & (F.col("ts") + lease_ms < F.col("next_claim"))).select("ns", "key", "delivery_no", (F.col("ts") + lease_ms).alias("lease_end"), "next_claim")


def completions(deliveries: DataFrame, lease_ms: int = S.LEASE_MS) -> DataFrame:
    """The winner's terminal write: applied if it still owns the lease, else refused."""
    win = claim_winners(deliveries.withColumn("next_claim", F.lead("ts").over(_first())))
    done = F.col("ts") + F.col("latency_ms")
    lost = F.col("next_claim").isNotNull() & (F.col("next_claim") <= done) & (F.col("ts") + lease_ms < F.col("next_claim"))
    status = F.when(lost, "indeterminate").when(F.col("fault") == "ok", "succeeded").when(F.col("fault") == "error", "failed").otherwise("indeterminate")
    return win.select("ns", "key", done.alias("completed_at"), status.alias("status"), F.when(lost, "E_LEASE_LOST").alias("code"))


def waits(deliveries: DataFrame, deadline_ms: int = S.DEADLINE_MS, poll_ms: int = S.POLL_MS) -> DataFrame:
    """When each later delivery sees the winner's terminal state on its polling grid, or gives up."""
    win = claim_winners(deliveries).select("ns", "key", F.col("delivery_no").alias("winner"), (F.col("ts") + F.col("latency_ms")).alias("completed_at"))
    x = deliveries.join(win, [*KEY]).where("delivery_no <> winner")
    gap = F.greatest(F.col("completed_at") - F.col("ts"), F.lit(0).cast("long"))
    polls = F.greatest(F.lit(1).cast("long"), F.ceil(gap / poll_ms))
    at = F.when(gap <= 0, F.col("ts")).otherwise(F.col("ts") + polls * poll_ms)
    limit = F.col("ts") + F.ceil(F.lit(deadline_ms) / poll_ms) * poll_ms
    return x.select("ns", "key", "delivery_no", F.least(at, limit).alias("observed_at"), F.when(at > limit, "E_WAIT_TIMEOUT").otherwise("terminal").alias("result"))


def sweep(effects: DataFrame, now: Column) -> DataFrame:
    """What retention removes: expired effects that are not in flight."""
    return effects.where((F.col("expires_at") <= now) & (F.col("status") != "in_flight"))


def settle_unexecuted(deliveries: DataFrame, effects: DataFrame, policy: Column) -> DataFrame:
    """What callers get while the breaker is open: a conflict first, then what is stored, else a refusal.

    ``effects`` has the stored fingerprint as ``stored``; a parked effect is told under the policy ``fail`` alone.
    """
    told = (
        F.when(F.col("fp") != F.col("stored"), "E_KEY_CONFLICT").when(F.col("status") == "succeeded", "replayed").when(F.col("status") == "failed", "E_EFFECT_FAILED")
        .when((F.col("status") == "indeterminate") & (policy == "fail"), "E_INDETERMINATE").otherwise("E_CIRCUIT_OPEN")
    )
    return deliveries.join(effects, [*KEY], "left").select(*KEY, "delivery_no", told.alias("settled"))


def policies(parked: DataFrame, policy: Column) -> DataFrame:
    """What a claim on a parked effect does under its policy."""
    action = F.when(policy == "reclaim", "claimed").when(policy == "gate", "gate_opened").otherwise("E_INDETERMINATE")
    return parked.select("*", action.alias("action"), (F.col("attempt") + F.when(policy == "reclaim", 1).otherwise(0)).cast("long").alias("next_attempt"))


def deadline_outcomes(deliveries: DataFrame, deadline_ms: Column) -> DataFrame:
    over = F.col("latency_ms") > deadline_ms
    return deliveries.select("ns", "key", "delivery_no", F.when(over, "indeterminate").when(F.col("fault") == "ok", "succeeded").otherwise("failed").alias("status"), F.when(over, "E_DEADLINE").alias("stored_code"))


def fold(deliveries: DataFrame, lease_ms: int = S.LEASE_MS) -> DataFrame:
    """The effect of every key after its whole log of claims and completions.

    Each delivery is a claim at ts and, unless it timed out, a completion at ts +
    latency_ms. The fold keeps status, attempt, owner and lease end; a claim parks an
    expired lease, a completion counts only for the owner in flight.
    """
    claim = F.struct("ts", F.lit(1).alias("kind"), "delivery_no", F.lit("claim").alias("op"), "fault")
    complete = F.struct((F.col("ts") + F.col("latency_ms")).alias("ts"), F.lit(0).alias("kind"), "delivery_no", F.lit("complete").alias("op"), "fault")
    commands = deliveries.select(*KEY, F.explode(F.when(F.col("fault") == "timeout", F.array(claim)).otherwise(F.array(claim, complete))).alias("c"))
    log = commands.groupBy(*KEY).agg(F.array_sort(F.collect_list("c")).alias("log"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("attempt"), F.lit(None).cast("long").alias("owner"), F.lit(None).cast("long").alias("lease_end"), F.lit(0).cast("long").alias("replays"))

    def step(s: Column, c: Column) -> Column:
        made = lambda status, attempt, owner, lease, replays: F.struct(status.alias("status"), attempt.alias("attempt"), owner.alias("owner"), lease.alias("lease_end"), replays.alias("replays"))
        none = F.lit(None).cast("long")
        ended = F.when(c["fault"] == "ok", "succeeded").otherwise("failed")
        opened = made(F.lit("in_flight"), F.lit(1).cast("long"), c["delivery_no"], c["ts"] + lease_ms, s["replays"])
        parked = made(F.lit("indeterminate"), s["attempt"], none, none, s["replays"])
        again = made(s["status"], s["attempt"], s["owner"], s["lease_end"], s["replays"] + F.when(s["status"] == "succeeded", 1).otherwise(0))
        done = made(ended, s["attempt"], none, none, s["replays"])
        owned = (s["status"] == "in_flight") & (s["owner"] == c["delivery_no"])
        claimed = F.when(s["status"].isNull(), opened).when((s["status"] == "in_flight") & (s["lease_end"] < c["ts"]), parked).otherwise(again)
        return F.when(c["op"] == "claim", claimed).when(owned, done).otherwise(s)

    return log.select(*KEY, F.aggregate("log", start, step).alias("s")).select(*KEY, "s.status", "s.attempt", "s.replays")
