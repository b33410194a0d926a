"""Calls of one worker that share a retry budget and, if any, a circuit breaker.

Arrivals are one second apart. Time, budget, window and the place in the worker's jitter
stream all depend on the calls before, so each case is one fold over its calls in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import limits as S

_OUT = "case string, seed int, i int, attempts bigint, landed bigint, code string, called_at bigint, parked_at bigint, took bigint"


def calls(work: DataFrame, breaker: bool = True) -> DataFrame:
    """case, seed, i, attempts, landed, code, called_at, parked_at, took of (case, seed, i, tries, faults, latencies)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        uniforms = draws.stream(f"{int(group['seed'].iloc[0])}:jitter:w1")
        now, budget, window, opened, open_ms, opens = 0.0, S.BUDGET_START, [], None, 0, 0
        rows = []

        def trip() -> None:
            nonlocal opened, open_ms, opens, window
            opens += 1
            base = min(S.MAX_OPEN_MS, S.OPEN_MS * 2 ** (opens - 1))
            open_ms = int(np.floor(base * (0.8 + 0.4 * next(uniforms)) + 0.5))
            opened, window = now, []

        for case, seed, i, most, planned, latencies in zip(*(group[n] for n in ("case", "seed", "i", "tries", "faults", "latencies")), strict=True):
            began, probe = now, opened is not None
            if probe and now < opened + open_ms:
                rows.append((case, seed, i, 0, 0, "E_CIRCUIT_OPEN", None, None, 0))
                now += 1_000
                continue
            budget = min(S.BUDGET_CAP, budget + S.BUDGET_DEPOSIT)
            tries, code, called = 0, None, began
            while code is None:
                called, fault, lasts = now, planned[tries], int(latencies[tries])
                tries += 1
                late = now + lasts >= began + S.DEADLINE_MS
                now = min(now + lasts, began + S.DEADLINE_MS)
                ok, lost = fault == "ok" and not late, fault == "timeout" or late
                if late:
                    pass  # the worker's own abort says nothing about the downstream
                elif probe:
                    if ok:
                        opened, opens, window = None, 0, []
                    else:
                        trip()
                elif breaker and opened is None:
                    window = [*window, int(not ok)][-S.WINDOW_SIZE :]
                    if len(window) >= S.MIN_SAMPLES and sum(window) >= S.THRESHOLD * len(window):
                        trip()
                if ok:
                    code = "ok"
                elif lost:  # the answer is lost, the effect may not be: never retried
                    code = "E_INDETERMINATE"
                elif tries >= (1 if probe else most):
                    code = "E_EFFECT_FAILED"
                elif budget < S.BUDGET_COST:
                    code = "E_RETRY_BUDGET"
                else:
                    budget -= S.BUDGET_COST
                    wait = next(uniforms) * min(S.RETRY_CAP_MS, S.RETRY_BASE_MS * 2**tries)
                    if now + wait > began + S.DEADLINE_MS:
                        code = "E_DEADLINE"
                    else:
                        now += wait
            landed = int(planned[tries - 1] != "error")
            rows.append((case, seed, i, tries, landed, code, int(called), int(now) if code == "E_INDETERMINATE" else None, int(now - began)))
            now += 1_000
        out = pd.DataFrame(rows, columns=[part.split()[0] for part in _OUT.split(", ")])
        return out.astype({"called_at": "Int64", "parked_at": "Int64"})

    return work.select("case", "seed", "i", "tries", "faults", "latencies").groupBy("case").applyInPandas(run, _OUT)


def play(work: DataFrame) -> DataFrame:
    """The runs of storms: what each call leaves behind, with the events it emits."""
    done = work.select("case", "scenario", "seed", "i", "intent", "effect_key", "gate_key").join(calls(work).drop("seed"), ["case", "i"])
    ran, good, parked = F.col("code") != "E_CIRCUIT_OPEN", F.col("code") == "ok", F.col("code") == "E_INDETERMINATE"
    starved = F.col("code") == "E_RETRY_BUDGET"
    status = F.when(good, "succeeded").when(parked, "indeterminate").when(ran, "failed")
    words = lambda *names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    failed = F.array_repeat(F.lit("effect.attempt_failed"), (F.col("attempts") - 1).cast("int"))
    events = F.when(ran, F.concat(words("effect.claimed"), failed, F.when(starved, words("retry.budget_exhausted")).otherwise(words()), F.array(F.concat(F.lit("effect."), status)))).otherwise(words())
    one = lambda x: F.when(x, 1).otherwise(0).cast("bigint")
    none = lambda kind: F.lit(None).cast(kind)
    return done.select(
        "case", "scenario", "seed", "i", "intent", "effect_key", "gate_key", status.alias("status"), none("string").alias("gate"), F.lit(1).cast("bigint").alias("deliveries"), "attempts", "landed",
        one(good).alias("reported"), F.lit(0).cast("bigint").alias("replays"), "parked_at", "called_at", F.lit(False).alias("reclaimed"), none("bigint").alias("expires_at"), none("bigint").alias("decided_at"),
        F.array("took").alias("durations"), events.alias("events"),
    )
