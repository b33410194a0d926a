"""The retry loop inside one lease: every check in its order, over the attempts of each call.

After an attempt: the deadline while it was in flight, success, what must not be retried,
the number of tries, a Retry-After beyond its cap, the budget, the deadline before the
next attempt; then the failure is told and the call waits. A fold over one call's few
attempts, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

_STATE = {"over": "boolean", "attempts": "int", "at": "bigint", "balance": "bigint", "status": "string", "code": "string", "events": "array<string>"}


def _made(values: dict[str, Column]) -> Column:
    return F.struct(*(values[name].cast(kind).alias(name) for name, kind in _STATE.items()))


def resolve(calls: DataFrame, *keys: str, deadline_ms: int = S.DEADLINE_MS) -> DataFrame:
    """keys, attempts, at, balance, status, code, events of calls (keys, tries, most, balance).

    ``tries`` has (n, kind, latency, hint, u) in order: kind is ok, retryable, failed or
    indeterminate, hint the Retry-After in ms or null, u the jitter's draw.
    """

    def step(s: Column, a: Column) -> Column:
        keep = {name: s[name] for name in _STATE}
        late = s["at"] + a["latency"] >= deadline_ms
        now = F.least(s["at"] + a["latency"], F.lit(deadline_ms))
        tried = s["attempts"] + 1
        spent = keep | {"attempts": tried, "at": now}
        ended = lambda status, code, **more: _made(spent | {"over": F.lit(True), "status": F.lit(status), "code": F.lit(code)} | more)
        told = lambda word: F.concat(s["events"], F.array(F.lit(word)))
        rich = s["balance"] >= S.BUDGET_COST
        wait = F.coalesce(a["hint"], F.floor(S.backoff_ms(a["u"], tried)).cast("bigint"))
        paid = {"balance": s["balance"] - S.BUDGET_COST}
        again = _made(spent | paid | {"at": now + wait, "events": told("effect.attempt_failed")})
        return (
            F.when(s["over"], _made(keep)).when(late, ended("indeterminate", "E_DEADLINE")).when(a["kind"] == "ok", ended("succeeded", None)).when(a["kind"] == "indeterminate", ended("indeterminate", "E_INDETERMINATE"))
            .when((a["kind"] == "failed") | (tried >= F.col("most")) | (a["hint"] > S.RETRY_AFTER_CAP_MS), ended("failed", "E_EFFECT_FAILED"))
            .when(~rich, ended("failed", "E_RETRY_BUDGET", events=told("retry.budget_exhausted"))).when(now + wait > deadline_ms, ended("failed", "E_DEADLINE", **paid)).otherwise(again)
        )

    start = {"over": F.lit(False), "attempts": F.lit(0), "at": F.lit(0), "balance": F.col("balance"), "status": F.lit(None), "code": F.lit(None), "events": F.array()}
    out = calls.select(*keys, F.inline(F.array(F.aggregate("tries", _made(start), step))).alias(*(f"_{name}" for name in _STATE)))
    return out.select(*keys, *(F.col(f"_{name}").alias(name) for name in ("attempts", "at", "balance", "status", "code", "events")))
