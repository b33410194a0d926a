"""The nine fault scenarios as command logs, folded into what they leave behind.

A case is a row of parameters; each of its intents becomes a log of commands (claims,
attempts, terminal writes, gate decisions, resumers) whose times, faults and latencies are
pure draws from the case's seed, and ``operators.runs`` folds it. Nothing is told about
the outcome here. Every intent is a row with its own log, so any number of cases is a
projection without a shuffle; only retry storms, whose calls share a budget and a
breaker, are folded case by case.

In other scenarios each intent has the retry budget of a process that has just started,
and retries follow at once: their jitter decides no outcome there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import faults
from ..functions import scalars as S
from ..operators import runs
from . import storm
from .cases import CASE, DEFAULTS, case

GATE_MS, DECISION_MS = 600_000, 60_000
RUN = ["case", "scenario", "seed", "i", "intent", "effect_key", "gate_key", "status", "gate", "deliveries", "attempts", "landed", "reported", "replays", "parked_at", "called_at", "reclaimed", "expires_at", "decided_at", "durations", "events"]


def cases(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [part.split()[0] for part in CASE.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], CASE)


def defaults(spark: SparkSession, seeds: int, names: list[str] | None = None) -> DataFrame:
    """The default case of each scenario for seeds 1..n."""
    each = cases(spark, [case(name, 0) for name in names or DEFAULTS]).drop("seed", "case")
    seeded = each.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    return seeded.withColumn("case", F.concat_ws(":", "scenario", F.col("seed").cast("string")))


def intents(plan: DataFrame) -> DataFrame:
    """One row for each intent of each case, with the keys of its effect and gate."""
    x = plan.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("intents") - 1)))
    x = x.withColumn("intent", F.concat(F.lit("intent-"), F.col("i").cast("string")))
    resumes, asks = F.col("scenario") == "crash-mid-gate", (F.col("scenario") == "crash-before-effect") & (F.col("variant") == "gate")
    held = F.when(asks, "did-land-").when(resumes | (F.col("scenario") == "out-of-order-decision"), "gate-")
    return x.withColumns({"effect_key": F.when(F.col("scenario") != "out-of-order-decision", F.concat(F.when(resumes, "resume-").otherwise(""), "intent")), "gate_key": F.concat(held, "intent")})


def _fixed(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: what follows refers to columns, not to their long expressions again and again."""
    return df.select(F.inline(F.array(F.struct("*"))))


def _between(u: Column, low: str, high: str) -> Column:
    """A whole number from low to high."""
    return F.when(F.col(high) > F.col(low), F.col(low) + F.floor(u * (F.col(high) - F.col(low) + 1))).otherwise(F.col(low))


def planned(work: DataFrame) -> DataFrame:
    """work with the faults and latencies of each intent's attempts, and its number of deliveries."""
    key = F.coalesce("effect_key", "intent")
    attempts = F.sequence(F.lit(1), F.col("tries"))
    u = lambda kind, a: faults.draw(F.col("seed"), F.concat_ws(":", F.lit(kind), key, a.cast("string")))
    late = lambda a: F.when(F.col("latency_high") > F.col("latency_low"), F.floor(F.col("latency_low") + u("latency", a) * (F.col("latency_high") - F.col("latency_low")) + 0.5)).otherwise(F.col("latency_low")).cast("bigint")
    return _fixed(work).withColumns(
        {
            "faults": F.transform(attempts, lambda a: faults.attempt_fault(F.col("seed"), key, a, F.col("error"), F.col("timeout"), F.col("overrides"))),
            "latencies": F.transform(attempts, late),
            "d": F.greatest(F.lit(1), _between(faults.draw(F.col("seed"), F.concat(F.lit("deliveries:"), "intent")), "deliveries_low", "deliveries_high").cast("int")),
        }
    )


def _command(at: Column, n: Column | int, op: str, who: Column | str, value: Column | str = "none", ms: Column | int = 0, seen: Column | None = None, needs: bool = False, quiet: bool = False) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(lit(at, "bigint"), lit(n, "int"), F.lit(op), lit(who, "string"), lit(at if seen is None else seen, "bigint"), lit(value, "string"), lit(ms, "bigint"), F.lit(needs), F.lit(quiet)).cast(runs.COMMAND)


def _attempted(work: DataFrame) -> DataFrame:
    """How the retry loop of a call goes: ``last`` attempt, ``spent`` ms, final ``ends``, whether it is ``starved``."""
    before = F.transform(F.sequence(F.lit(0), F.col("tries") - 1), lambda k: F.aggregate(F.slice("latencies", 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    x = _fixed(_fixed(work).withColumn("begins", before))
    funded = (S.BUDGET_START + S.BUDGET_DEPOSIT) // S.BUDGET_COST
    most = F.least(F.col("tries") - 1, F.lit(funded))
    over = lambda k: F.get("begins", k) + F.get("latencies", k) >= S.DEADLINE_MS
    stops = F.get(F.filter(F.sequence(F.lit(0), most), lambda k: (F.get("faults", k) != "error") | over(k)), 0)
    x = _fixed(x.withColumn("stops", stops)).withColumns({"last": F.coalesce("stops", most), "starved": F.col("stops").isNull() & (F.col("tries") - 1 > funded)})
    x = _fixed(x)
    late = over(F.col("last"))
    fault = F.get("faults", F.col("last"))
    ends = F.when(late | (fault == "timeout"), "indeterminate").when(fault == "ok", "succeeded").otherwise("failed")
    return _fixed(x.withColumns({"late": late, "ends": ends, "spent": F.least(F.get("begins", F.col("last")) + F.get("latencies", F.col("last")), F.lit(S.DEADLINE_MS))}))


def _run(at: Column, who: Column | str, n: Column | int, policy: str = "fail", skew: Column | int = 0, needs: bool = False, crash: str = "") -> Column:
    """The commands of one delivery; a process that crashes leaves out what it did not live to do."""
    n = n if isinstance(n, Column) else F.lit(n)
    seen = at + skew
    claim = _command(at, n, "claim", who, policy, GATE_MS if policy == "gate" else S.LEASE_MS, seen, needs, quiet=crash == "after-claim")
    if crash == "after-claim":
        return F.array(claim)

    def called(k: Column) -> Column:
        fault = F.get("faults", k)
        value = F.when(k < F.col("last"), "retried").when(F.col("late") & (fault != "error"), "lost").otherwise(fault)
        return _command(at + F.get("begins", k), n + 1 + k, "call", who, value)

    calls = F.transform(F.sequence(F.lit(0), F.col("last")), called)
    end = at + F.col("spent")
    starved = F.when(F.col("starved"), F.array(_command(end, n + 900, "starved", who))).otherwise(F.array().cast(f"array<{runs.COMMAND}>"))
    if crash == "before-complete":
        return F.concat(F.array(claim), calls, starved)
    return F.concat(F.array(claim), calls, starved, F.array(_command(end, n + 1_000, "complete", who, F.col("ends"))))


def logs(plan: DataFrame) -> DataFrame:
    """The command log of every intent, but those of retry storms."""
    x = _attempted(planned(intents(plan.where("scenario <> 'retry-storm'"))))
    t0 = F.lit(0).cast("bigint")
    expired = F.col("spent") + S.LEASE_MS + 1
    which = lambda names: F.when(F.col("variant").isin("", "mixed"), F.get(F.array(*map(F.lit, names)), F.col("i") % len(names))).otherwise(F.col("variant"))

    again = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda k: _run(t0, F.concat(F.when(k % 2 == 0, "w1:").otherwise("w2:"), k.cast("string")), k * 10_000))
    duplicates = F.flatten(again)
    timeouts = F.concat(_run(t0, "w1", 0), _run(t0 + 2 * S.DEADLINE_MS, "w2", 0))
    mid_effect = F.concat(_run(t0, "a", 0, crash="before-complete"), _run(expired, "w2", 0))

    died, found = _run(t0, "a", 0, crash="after-claim"), t0 + S.LEASE_MS + 1
    answered = F.array(_command(found + 1, 0, "decide", "h", "approved"), _command(found + 2, 0, "take", "r", ms=S.CLAIM_LEASE_MS), _command(found + 3, 0, "ack", "r"))
    before_effect = F.concat(
        died,
        F.when(F.col("variant") == "gate", F.concat(_run(found, "w2", 0, "gate"), answered))
        .when(F.col("variant") == "reclaim", F.concat(_run(found, "w2", 0), _run(found + 1, "w2:again", 0, "reclaim")))
        .otherwise(_run(found, "w2", 0)),
    )

    turn = S.CLAIM_LEASE_MS + S.DEADLINE_MS + 1
    resume = lambda k, who: F.concat(F.array(_command(t0 + 2 + k * turn, 0, "take", who, ms=S.CLAIM_LEASE_MS)), _run(t0 + 2 + k * turn, who, 1, needs=True))
    doomed = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.col("crashes")), lambda k: k < F.col("crashes")), lambda k: resume(k, F.concat(F.lit("r"), k.cast("string")))))
    survivor = F.concat(resume(F.col("crashes"), "z"), F.array(_command(t0 + 2 + F.col("crashes") * turn + F.col("spent"), 2_000, "ack", "z")))
    mid_gate = F.concat(F.array(_command(t0, 0, "open", "o", ms=GATE_MS), _command(t0 + 1, 0, "decide", "h", "approved")), doomed, survivor)

    skew = F.when(which(["within", "beyond"]) == "beyond", 2 * S.LEASE_MS + 1).otherwise(S.LEASE_MS // 2)
    skewed = F.concat(_run(t0, "w1", 0), _run(t0, "w2", 10_000, skew=skew))

    order = which(["approve-first", "reject-first", "late"])
    first = F.when(order == "reject-first", "rejected").otherwise("approved")
    second = F.when(order == "reject-first", "approved").otherwise("rejected")
    race = F.array(_command(t0 + 1, 0, "decide", "ha", first), _command(t0 + 1, 1, "decide", "hb", second))
    decisions = F.concat(F.array(_command(t0, 0, "open", "opener", ms=DECISION_MS)), F.when(order == "late", F.array(_command(t0 + DECISION_MS + 1, 0, "decide", "ha", "approved"))).otherwise(race))

    scripts = {
        "duplicate-delivery": duplicates, "timeout-then-success": timeouts, "crash-mid-effect": mid_effect, "crash-before-effect": before_effect, "crash-mid-gate": mid_gate,
        "clock-skew": skewed, "slow-downstream": _run(t0, "w1", 0), "out-of-order-decision": decisions,
    }
    log = F.coalesce(*(F.when(F.col("scenario") == name, script) for name, script in scripts.items()))
    return x.select("case", "scenario", "seed", "i", "intent", "effect_key", "gate_key", log.alias("log"))


def play(plan: DataFrame) -> DataFrame:
    """What every intent of every case leaves behind: the columns of ``RUN``."""
    folded = runs.fold(logs(plan), *RUN[:7]).select(*RUN)
    return folded.unionByName(storm.play(planned(intents(plan.where("scenario = 'retry-storm'")))).select(*RUN))


def violations(played: DataFrame, gate: float = 1.5) -> DataFrame:
    """case, intent, rule: invariants that intents break, and I6 for storms that call downstream too often."""
    each = runs.violations(played, "case", "intent", resumed=F.col("scenario") == "crash-mid-gate")
    calls = played.where("scenario = 'retry-storm'").groupBy("case").agg((F.sum("attempts") / F.count(F.lit(1))).alias("factor")).where(F.col("factor") > gate)
    return each.unionByName(calls.select("case", F.lit(None).cast("string").alias("intent"), F.lit("I6").alias("rule")))
