"""Streaming twins of the batch operators, for logs that never end.

State is keyed and expires; late rows are judged by their own times, never by arrival.
Running an effect itself belongs in ``foreachBatch`` behind a conditional write: tasks
may be retried, so a function inside a query may run twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import limits as S

RETENTION = "7 days"
OUTCOME = "key string, delivery_no long, ts_ms long, status string, first_seen_at long"


def with_event_time(deliveries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A delivery stream (ts in milliseconds) with a watermark on ``event_time``."""
    return deliveries.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", delay)


def first_deliveries(deliveries: DataFrame, retention: str = RETENTION) -> DataFrame:
    """Each effect's first delivery within the retention: plain deduplication."""
    return deliveries.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", retention).dropDuplicatesWithinWatermark(["ns", "key"])


class Collapse(StatefulProcessor):
    """executed for the first delivery of a key, replayed with its time for later ones."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "first_seen_at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.first.get()[0] if self.first.exists() else None
        out = []
        # a micro-batch may bring a key's deliveries in any order
        for n, ts in sorted(((int(n), int(t)) for b in rows for n, t in zip(b["delivery_no"], b["ts"], strict=True)), key=lambda r: (r[1], r[0])):
            status = "executed" if seen is None else "replayed"
            seen = ts if seen is None else seen
            out.append((key[0], n, ts, status, seen))
        self.first.update((seen,))
        yield pd.DataFrame(out, columns=["key", "delivery_no", "ts_ms", "status", "first_seen_at"])

    def close(self) -> None:
        pass


def collapse(deliveries: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """``effects.collapse`` over a stream (key, delivery_no, ts); needs the RocksDB state store."""
    return deliveries.select("key", "delivery_no", "ts").groupBy("key").transformWithStateInPandas(statefulProcessor=Collapse(ttl_ms), outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class GateTimeouts(StatefulProcessor):
    """A gate's end: its first decision before the expiry, else a timeout once event time passes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", "expires_at long, on_timeout string")
        self.done = handle.getValueState("done", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        ordered = sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: (r.op != "open", r.ts))
        for r in ordered:
            if r.op == "open" and not self.gate.exists():
                self.gate.update((int(r.expires_at), r.on_timeout))
                self.handle.registerTimer(int(r.expires_at))
            elif r.op != "open" and self.gate.exists() and not self.done.exists() and r.ts < self.gate.get()[0]:
                self.done.update((int(r.ts),))
                out.append((key[0], r.op, int(r.ts)))
        yield pd.DataFrame(out, columns=["id", "status", "decided_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.gate.exists() and not self.done.exists():
            expires_at, on_timeout = self.gate.get()
            self.done.update((expires_at,))
            out.append((key[0], "approved" if on_timeout == "approve" else "timed_out", expires_at))
        yield pd.DataFrame(out, columns=["id", "status", "decided_at"])

    def close(self) -> None:
        pass


def gate_ends(commands: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Ends of gates of a stream (id, op, ts, expires_at, on_timeout); op is open, approved or rejected."""
    timed = commands.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", delay)
    return timed.groupBy("id").transformWithStateInPandas(statefulProcessor=GateTimeouts(), outputStructType="id string, status string, decided_at long", outputMode="Append", timeMode="EventTime")


class Chain(StatefulProcessor):
    """Sequence and hash of events as they come: one task for each namespace, by definition."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import hashlib

        seq, head = self.head.get() if self.head.exists() else (0, None)
        out = []
        for ts, event_id, payload in sorted((int(t), int(e), p) for b in rows for t, e, p in zip(b["ts"], b["event_id"], b["payload"], strict=True)):
            prev, seq = head, seq + 1
            head = hashlib.sha256(((prev or "") + payload).encode()).hexdigest()
            out.append((key[0], event_id, seq, prev, head))
        self.head.update((seq, head))
        yield pd.DataFrame(out, columns=["ns", "event_id", "seq", "prev_hash", "hash"])

    def close(self) -> None:
        pass


def chain(events: DataFrame) -> DataFrame:
    """The audit chain of a stream (ns, event_id, ts, payload) that arrives in order of its micro-batches."""
    return events.groupBy("ns").transformWithStateInPandas(statefulProcessor=Chain(), outputStructType="ns string, event_id long, seq long, prev_hash string, hash string", outputMode="Append", timeMode="None")


class Leases(StatefulProcessor):
    """Parks an execution whose lease ends in event time before its owner completes it; heartbeats move the end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.effect = handle.getValueState("effect", "status string, owner string, lease_end long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        status, owner, end = self.effect.get() if self.effect.exists() else (None, None, None)
        for r in sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: (r.ts, r.n)):
            ts = int(r.ts)
            if status == "in_flight" and end < ts:
                out.append((*key, "indeterminate", end))
                status, owner = "indeterminate", None
            if r.op == "claim" and status is None:
                status, owner, end = "in_flight", r.owner, ts + int(r.lease_ms)
                self.handle.registerTimer(end + 1)
            elif r.op == "heartbeat" and status == "in_flight" and owner == r.owner:
                end = ts + int(r.lease_ms)
                self.handle.registerTimer(end + 1)
            elif r.op == "complete" and status == "in_flight" and owner == r.owner:
                status, owner = r.status, None
                out.append((*key, status, ts))
        if status is not None:
            self.effect.update((status, owner, end))
        yield pd.DataFrame(out, columns=["ns", "key", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.effect.exists():
            status, _, end = self.effect.get()
            if status == "in_flight" and end < expiredTimerInfo.getExpiryTimeInMs():
                self.effect.update(("indeterminate", None, end))
                out.append((*key, "indeterminate", end))
        yield pd.DataFrame(out, columns=["ns", "key", "status", "at"])

    def close(self) -> None:
        pass


def lease_ends(commands: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Ends of effects of a stream (ns, key, n, op, ts, owner, lease_ms, status): completed, or parked once their lease is over."""
    timed = commands.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", delay)
    return timed.groupBy("ns", "key").transformWithStateInPandas(statefulProcessor=Leases(), outputStructType="ns string, key string, status string, at long", outputMode="Append", timeMode="EventTime")


class Bucket(StatefulProcessor):
    """The retry budget of a circuit, call by call."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "tenths long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tenths, out = self.balance.get()[0] if self.balance.exists() else S.BUDGET_START, []
        for n, wanted in sorted((int(n), int(w)) for b in rows for n, w in zip(b["n"], b["wanted"], strict=True)):
            tenths = min(S.BUDGET_CAP, tenths + S.BUDGET_DEPOSIT)
            paid = min(wanted, tenths // S.BUDGET_COST)
            tenths -= paid * S.BUDGET_COST
            out.append((key[0], n, paid, paid < wanted))
        self.balance.update((tenths,))
        yield pd.DataFrame(out, columns=["circuit", "n", "funded", "denied"])

    def close(self) -> None:
        pass


def funded(calls: DataFrame) -> DataFrame:
    """Retries that the budget of each circuit funds, of a stream (circuit, n, wanted) in order of its micro-batches."""
    return calls.groupBy("circuit").transformWithStateInPandas(statefulProcessor=Bucket(), outputStructType="circuit string, n long, funded long, denied boolean", outputMode="Append", timeMode="None")


def on_worker_clocks(rows: DataFrame, skews: DataFrame) -> DataFrame:
    """rows with ts as their worker's own clock shows it; ``skews`` (worker, skew_ms) is a small static table."""
    return rows.join(skews, "worker", "left").withColumn("ts", F.col("ts") + F.coalesce("skew_ms", F.lit(0))).drop("skew_ms")


def deliver_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):  # type: ignore[no-untyped-def]
    """Hands micro-batches to an idempotent sink, by batch id, under a checkpoint."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
