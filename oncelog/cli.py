"""Command line: gates of a JSON state folder, and the scenario suite.

Exit codes: 0 done, 1 violations found, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gates as G
from .plans import golden, scenarios, workload
from .sources.snapshots import load_json, save_json

GATE = "id string, ns string, key string, status string, created_at long, expires_at long, on_timeout string, decided_at long, decided_by string, reason string"
STATUSES = ("pending", "approved", "rejected", "timed_out", "cancelled")


def sweep(gates: DataFrame, now: int) -> DataFrame:
    """Pending gates past their expiry, resolved."""
    over = (F.col("status") == "pending") & (F.col("expires_at") <= now)
    ended = F.when(F.col("on_timeout") == "approve", "approved").otherwise("timed_out")
    return gates.withColumns(
        {"decided_at": F.when(over, F.col("expires_at")).otherwise(F.col("decided_at")), "decided_by": F.when(over, "engine:timeout").otherwise(F.col("decided_by")), "status": F.when(over, ended).otherwise(F.col("status"))}
    )


def decide(gates: DataFrame, gate_id: str, status: str, by: str, reason: str | None, now: int) -> DataFrame:
    """The first decision before the expiry wins; others leave the gate as it is."""
    hit = (F.col("id") == gate_id) & (F.col("status") == "pending")
    return gates.withColumns({"decided_at": F.when(hit, F.lit(now)).otherwise(F.col("decided_at")), "decided_by": F.when(hit, by).otherwise(F.col("decided_by")), "reason": F.when(hit, F.lit(reason)).otherwise(F.col("reason")), "status": F.when(hit, status).otherwise(F.col("status"))})


def chaos(spark: SparkSession, seeds: int, client: str) -> int:
    """Plays the scenarios, or the baseline workload by a naive client, and tells what invariants break."""
    if client == "naive":
        b = workload.BASELINE
        played = workload.as_runs(workload.naive(workload.intents(spark, seeds, b["intents"]), *b["deliveries"], b["error"], b["timeout"]))
        broken = scenarios.violations(played)
    else:
        played = scenarios.play(scenarios.defaults(spark, seeds))
        broken = scenarios.violations(played).unionByName(golden.fuzz_report(spark, 200))
    for r in workload.rollup(played).orderBy("scenario").toLocalIterator():
        print(f"{r.scenario or 'total'}: {r.intents} intents, {r.ledger} landed, {r.attempts} attempts, {r.duplicates} duplicates")
    rules = broken.groupBy("rule").count().orderBy("rule").collect()  # one row for each invariant
    for r in rules:
        print(f"{r.rule}: broken {r['count']} times")
    return 1 if rules else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, now: int | None = None) -> int:
    parser = argparse.ArgumentParser(prog="oncelog")
    commands = parser.add_subparsers(dest="command", required=True)
    gates = commands.add_parser("gates").add_subparsers(dest="action", required=True)
    for action in ("ls", "show", "approve", "reject"):
        p = gates.add_parser(action)
        p.add_argument("--state", default="gates.json")
        if action == "ls":
            p.add_argument("--namespace")
            p.add_argument("--status", choices=STATUSES)
        else:
            p.add_argument("id")
        if action in ("approve", "reject"):
            p.add_argument("--by", default="cli")
            p.add_argument("--reason")
    suite = commands.add_parser("chaos")
    suite.add_argument("--seeds", "--seed", type=int, default=workload.SEEDS)
    suite.add_argument("--client", choices=("engine", "naive"), default="engine")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("oncelog").getOrCreate()
    now = int(time.time() * 1000) if now is None else now
    if args.command == "chaos":
        return chaos(spark, args.seeds, args.client)
    state = sweep(load_json(spark, args.state, GATE), now)
    if args.action == "show":
        row = state.where(F.col("id") == args.id).select(F.to_json(F.struct("*"))).first()
        print(row[0] if row else "no such gate")
        return 0
    if args.action in ("approve", "reject"):
        state = decide(state, args.id, {"approve": "approved", "reject": "rejected"}[args.action], args.by, args.reason, now)
    # written beside the state first, as a folder can't be read and replaced at once
    save_json(state, f"{args.state}.next")
    save_json(load_json(spark, f"{args.state}.next", GATE), args.state)
    kept = load_json(spark, args.state, GATE)
    shown = G.listed(kept, args.namespace, args.status) if args.action == "ls" else kept.where(F.col("id") == args.id)
    for r in shown.select("id", "ns", "status").toLocalIterator():
        print(f"{r.id}\t{r.ns}\t{r.status}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
