"""Circuit breakers and retry budgets: ordered passes over the calls of one circuit."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import limits as S
from .carry import carry


def rolling_ratio(outcomes: DataFrame, size: int = S.WINDOW_SIZE) -> DataFrame:
    """Failures and samples among the last ``size`` outcomes of each circuit."""
    w = Window.partitionBy("circuit").orderBy("n").rowsBetween(1 - size, 0)
    return outcomes.select("circuit", "n", F.count_if(~F.col("ok")).over(w).alias("failures"), F.count(F.lit(1)).over(w).alias("samples"))


class Breaker:
    """One circuit: what it admits, and what reported outcomes make of it.

    Closed: outcomes fill a window, and ``THRESHOLD`` failures of ``MIN_SAMPLES`` or more open
    the circuit for a jittered interval. Open: calls are refused until it is over; the next
    call is the single probe (half open), and others are refused while that may still
    answer. A probe's success closes the circuit, its failure opens it for about twice as
    long; one that has not answered within ``PROBE_MS`` is presumed dead, the next call is a
    probe in its place, and its late answer settles nothing. An outcome of a call that was
    admitted before the circuit opened changes nothing either.
    """

    def __init__(self, circuit: str):
        self.state, self.window, self.opened_at, self.open_ms, self.opens = "closed", [], None, None, 0
        self.owner, self.expires_at, self.refused, self.version, self.probes = None, None, 0, 0, 0
        self.waiting: dict[int, bool] = {}  # admitted calls that will answer, and whether they are probes
        self.jitter: Iterator[float] = draws.stream(f"1:jitter:{circuit}")

    def _trip(self, at: int) -> str:
        self.opens += 1
        base = min(S.MAX_OPEN_MS, S.OPEN_MS * 2 ** (self.opens - 1))
        self.state, self.window, self.opened_at, self.open_ms = "open", [], at, int(base * (0.8 + 0.4 * next(self.jitter)) + 0.5)
        self.owner, self.expires_at, self.version = None, None, self.version + 1
        return "circuit.opened"

    def admit(self, n: int, at: int, answers: bool) -> str | None:
        """The event that a call causes on its way in."""
        event, probe = None, False
        if self.state != "closed":
            over = at >= self.opened_at + self.open_ms if self.state == "open" else self.expires_at < at
            if not over:
                self.refused += 1
                return None
            self.state, self.owner, self.expires_at, self.version, self.probes = "half_open", n, at + S.PROBE_MS, self.version + 1, self.probes + 1
            event, probe = "circuit.half_open", True
        if answers:
            self.waiting[n] = probe
        return event

    def record(self, n: int, at: int, ok: bool) -> str | None:
        """The event that a call's outcome causes."""
        probe = self.waiting.pop(n, None)
        if probe is None:  # it was refused
            return None
        if probe:
            if self.state != "half_open" or self.owner != n:
                return None
            if not ok:
                return self._trip(at)
            self.state, self.window, self.opened_at, self.open_ms, self.opens = "closed", [], None, None, 0
            self.owner, self.expires_at, self.version = None, None, self.version + 1
            return "circuit.closed"
        if self.state != "closed":
            return None
        self.window = [*self.window, int(not ok)][-S.WINDOW_SIZE :]
        if len(self.window) >= S.MIN_SAMPLES and sum(self.window) >= S.THRESHOLD * len(self.window):
            return self._trip(at)
        self.version += 1
        return None


def _steps(outcomes: DataFrame) -> DataFrame:
    """circuit, at, kind, n, ok, answers: each call on its way in (1), and its outcome (0, or 2 if it takes no time) where it reports one."""
    answers = F.col("took").isNotNull()
    admit = F.struct(F.col("ts").alias("at"), F.lit(1).alias("kind"))
    record = F.struct((F.col("ts") + F.col("took")).alias("at"), F.when(F.col("took") > 0, 0).otherwise(2).alias("kind"))
    each = F.explode(F.when(answers, F.array(admit, record)).otherwise(F.array(admit)))
    return outcomes.select("circuit", "n", "ok", answers.alias("answers"), each.alias("s")).select("circuit", "s.at", "s.kind", "n", "ok", "answers")


def _advance(b: Breaker | None, row: tuple) -> tuple[Breaker, str | None]:
    circuit, at, kind, n, ok, answers = row
    b = b or Breaker(circuit)
    return b, (b.admit(n, at, answers) if kind == 1 else b.record(n, at, ok))


def fold(outcomes: DataFrame) -> DataFrame:
    """The state of every circuit after its calls (circuit, n, ts, ok, took; took null: no answer ever), and how many it refused."""

    def end(circuit: str, b: Breaker) -> tuple:
        return circuit, b.state, b.window, b.opened_at, b.open_ms, b.opens, b.refused, b.probes, b.version

    schema = "circuit string, state string, window array<int>, opened_at bigint, open_ms bigint, opens int, refused bigint, probes bigint, version bigint"
    return carry(_steps(outcomes), "circuit", ["at", "kind", "n"], lambda b, row: (_advance(b, row)[0], None), schema, end=end)


def events(outcomes: DataFrame) -> DataFrame:
    """circuit, at, n, type of every event that circuits emit: opened, half open, closed."""

    def step(b: Any, row: tuple) -> tuple[Any, tuple | None]:
        b, event = _advance(b, row)
        return b, None if event is None else (row[0], row[1], row[3], event)

    return carry(_steps(outcomes), "circuit", ["at", "kind", "n"], step, "circuit string, at bigint, n bigint, type string")


def compare_and_set(writes: DataFrame) -> DataFrame:
    """(circuit, n, expected): how many conditional writes apply; null expects no record."""

    def step(s: tuple | None, row: tuple) -> tuple[tuple, None]:
        version, applied, refused = s or (None, 0, 0)
        return ((version or 0) + 1, applied + 1, refused) if row[2] == version else (version, applied, refused + 1), None

    rows = writes.select("circuit", "n", F.col("expected").cast("bigint").alias("expected"))
    return carry(rows, "circuit", ["n"], step, "circuit string, version bigint, applied bigint, refused bigint", end=lambda circuit, s: (circuit, *s))


def budget(calls: DataFrame) -> DataFrame:
    """(circuit, n, wanted): retries that a token bucket funds.

    In tenths: each executed call adds 1 up to 100, each retry takes 10 where they are there.
    """

    def step(s: tuple | None, row: tuple) -> tuple[tuple, None]:
        balance, funded, denied = s or (S.BUDGET_START, 0, 0)
        have = min(S.BUDGET_CAP, balance + S.BUDGET_DEPOSIT)
        paid = min(row[2], have // S.BUDGET_COST)
        return (have - paid * S.BUDGET_COST, funded + paid, denied + (paid < row[2])), None

    return carry(calls.select("circuit", "n", "wanted"), "circuit", ["n"], step, "circuit string, balance bigint, funded bigint, denied bigint", end=lambda circuit, s: (circuit, *s))
