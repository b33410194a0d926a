"""The suite's results as one nested row, a JSON file and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.snapshots import restore, save
from . import golden, scenarios, workload

FUZZED = 200


def latency(samples: DataFrame) -> DataFrame:
    """samples, p50, p99 of (ms): one row."""
    one = metrics.percentile(samples, "ms", 0.5).join(metrics.percentile(samples, "ms", 0.99))  # a row each
    return samples.agg(F.count(F.lit(1)).alias("samples")).join(one)


def results(spark: SparkSession, seeds: int = workload.SEEDS) -> DataFrame:
    """One row: totals, scenarios, both baselines, amplification, latency, invariants, goldens and fuzz cases."""
    played = restore(spark, save(scenarios.play(scenarios.defaults(spark, seeds)), "played"))  # a few hundred rows that eight figures are read from
    rows = workload.rollup(workload.of_runs(played))
    counts = ["intents", "deliveries", "ledger", "attempts", "duplicates"]
    parts = [rows.where("scenario IS NULL").select(F.struct(*counts).alias("totals"))]
    parts.append(rows.where("scenario IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("scenario", *counts))).alias("scenarios")))
    b = workload.BASELINE
    work = workload.intents(spark, seeds, b["intents"])
    dup = F.sum(F.greatest(F.lit(0), F.col("landed") - 1)).cast("bigint").alias("duplicates")
    parts.append(
        workload.naive(work, *b["deliveries"], b["error"], b["timeout"]).agg(
            F.struct(F.sum("deliveries").alias("deliveries"), F.sum("attempts").alias("attempts"), dup, F.avg(F.col("succeeded").cast("int")).alias("success_rate")).alias("naive")
        )
    )
    parts.append(
        workload.client(work, b["error"], b["timeout"], breaker=False).agg(
            F.struct(F.sum("attempts").alias("attempts"), dup, F.avg((F.col("code") == "ok").cast("int")).alias("success_rate"), F.avg((F.col("code") == "E_INDETERMINATE").cast("int")).alias("fail_closed_rate")).alias("engine")
        )
    )
    storm = rows.where("scenario = 'retry-storm'")
    parts.append(storm.agg(F.first(metrics.round4(F.col("attempts") / F.col("intents"))).alias("amplification")))
    parts.append(latency(played.select(F.explode("durations").alias("ms"))).select(F.struct("samples", "p50", "p99").alias("latency")))
    parts.append(scenarios.violations(played).agg(F.count(F.lit(1)).alias("violations")))
    fixtures = golden.fixtures(spark)
    bad = golden.differences(golden.expected(fixtures), golden.replay(fixtures)).select("id").distinct()
    both = fixtures.select("id").join(bad.withColumn("bad", F.lit(True)), "id", "left")
    parts.append(both.agg(F.struct(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bad").isNull()).alias("passed")).alias("golden")))
    parts.append(golden.fuzz_report(spark, FUZZED).agg(F.struct(F.lit(FUZZED).alias("seeds"), F.count(F.lit(1)).alias("violations")).alias("fuzz")))
    out = parts[0]
    for part in parts[1:]:  # each is one row
        out = out.join(F.broadcast(part))
    return out


def write(result: DataFrame, folder: str, day: str, revision: str) -> None:
    """The results as JSON, as the latest and under their day and revision."""
    stamped = result.withColumns({"day": F.lit(day), "revision": F.lit(revision)})
    for name in ("latest", f"{day}-{revision}"):
        stamped.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def markdown(row) -> str:  # type: ignore[no-untyped-def]
    """The report of one collected result row."""
    lines = ["| Scenario | intents | deliveries | ledger | attempts | duplicates |", "|---|---|---|---|---|---|"]
    lines += [f"| {s.scenario} | {s.intents:,} | {s.deliveries:,} | {s.ledger:,} | {s.attempts:,} | {s.duplicates:,} |" for s in row.scenarios]
    percent = lambda x: f"{round(100 * x)} %"
    lines += ["", f"Naive: {percent(row.naive.success_rate)} succeeded, {row.naive.duplicates:,} duplicates, {row.naive.attempts:,} attempts.",
              f"Engine: {percent(row.engine.success_rate)} succeeded, {row.engine.duplicates} duplicates, {row.engine.attempts:,} attempts, {percent(row.engine.fail_closed_rate)} failed closed.",
              f"Retry amplification under a storm: {row.amplification}. Invariants broken: {row.violations}.",
              f"Runs: {row.latency.samples:,}, p50 {row.latency.p50:,} ms, p99 {row.latency.p99:,} ms of virtual time.",
              f"Golden traces: {row.golden.passed} of {row.golden.total}. Fuzz cases: {row.fuzz.seeds}, violations: {row.fuzz.violations}."]
    return "\n".join(lines) + "\n"


def inject(document: str, block: str, name: str = "report") -> str:
    """The document with the text between its marks replaced."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    head, found, rest = document.partition(begin)
    tail = rest.partition(end)
    if not found or not tail[1]:
        raise ValueError(f"the document has no marks for {name}")
    return f"{head}{begin}\n{block}{end}{tail[2]}"
