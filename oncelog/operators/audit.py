"""The audit log: a sequence and a hash chain for each namespace.

Building a chain is sequential within a namespace by definition (each hash contains the
last), so it is one ordered pass over that namespace's events that carries the head alone.
Verifying one is not: each row is compared with the recorded hash of the row before it, in
one window pass.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .carry import carry

CHAIN = "ns string, event_id bigint, seq bigint, ts bigint, payload string, prev_hash string, hash string"


def _order():  # type: ignore[no-untyped-def]
    return Window.partitionBy("ns").orderBy("seq")


def sequence(events: DataFrame) -> DataFrame:
    """events with seq 1..n within each namespace."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("ns").orderBy("ts", "event_id")).cast("long"))


def payload() -> Column:
    """Canonical JSON of an event's content; the sequence is no part of it."""
    q = lambda name: S.json_string(F.col(name))
    return S.canonical_object(actor=q("actor"), attempt=F.col("attempt"), data=F.col("data"), namespace=q("ns"), subjectKey=q("subject_key"), subjectType=q("subject_type"), ts=F.col("ts"), type=q("type"))


def link(prev: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), content).cast("binary"), 256)


def _linked(head: str | None, row: tuple) -> tuple[str, tuple]:
    """The next hash of a chain, and the row that records it; the row brings the head that its chain begins with."""
    ns, seq, event_id, ts, content, first, base = row
    before = first if head is None else head
    h = hashlib.sha256(((before or "") + content).encode()).hexdigest()
    return h, (ns, event_id, seq + base, ts, content, before, h)


def _built(events: DataFrame, last: DataFrame | None) -> DataFrame:
    each = sequence(events).select("ns", "seq", F.col("event_id").cast("bigint").alias("event_id"), "ts", payload().alias("payload"))
    if last is None:
        each = each.withColumns({"head": F.lit(None).cast("string"), "base": F.lit(0).cast("bigint")})
    else:
        each = each.join(last, "ns", "left").withColumn("base", F.coalesce("base", F.lit(0).cast("bigint")))
    return carry(each.select("ns", "seq", "event_id", "ts", "payload", "head", "base"), "ns", ["seq"], _linked, CHAIN)


def chain(events: DataFrame) -> DataFrame:
    """(ns, event_id, seq, ts, payload, prev_hash, hash) of sequenced events."""
    return _built(events, None)


def heads(events: DataFrame) -> DataFrame:
    """ns, seq, head_hash: the end of each chain."""
    return chain(events).groupBy("ns").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("head_hash"))


def verify(rows: DataFrame) -> DataFrame:
    """ns, ok, broken_at, checked of recorded rows (ns, seq, payload, prev_hash, hash)."""
    before = F.lag("hash").over(_order())
    good = F.col("prev_hash").eqNullSafe(before) & (F.col("hash") == link(before, F.col("payload")))
    each = rows.select("ns", (F.row_number().over(_order()) - 1).cast("long").alias("i"), F.coalesce(good, F.lit(False)).alias("good"))
    out = each.groupBy("ns").agg(F.min(F.when(~F.col("good"), F.col("i"))).alias("broken_at"), F.count(F.lit(1)).alias("n"))
    return out.select("ns", F.col("broken_at").isNull().alias("ok"), "broken_at", F.coalesce("broken_at", "n").alias("checked"))


def since(rows: DataFrame, ns: str, seq: int, limit: int = 100) -> DataFrame:
    return rows.where((F.col("ns") == ns) & (F.col("seq") > seq)).orderBy("seq").limit(limit)


def pages(rows: DataFrame, page_size: int = 500) -> DataFrame:
    """rows with the page that an export puts them on."""
    return rows.withColumn("page", F.floor((F.col("seq") - 1) / page_size).cast("long"))


def with_defaults(inputs: DataFrame, ns: str, owner: str) -> DataFrame:
    """Events to append, with the namespace, actor and data of their writer where they have none."""
    defaults = {"ns": F.lit(ns), "actor": F.lit(owner), "data": F.lit("{}"), "attempt": F.lit(None).cast("int")}
    return inputs.withColumns({name: F.coalesce(F.col(name), value) if name in inputs.columns else value for name, value in defaults.items()})


def notes(deliveries: DataFrame, text: Column) -> DataFrame:
    """A note event for each execution: it never decides anything about the effect."""
    data = S.canonical_object(note=S.json_string(text))
    return deliveries.select("ns", "ts", F.col("delivery_no").alias("event_id"), F.lit("effect").alias("subject_type"), F.col("key").alias("subject_key"), F.lit("note").alias("type"), F.lit(1).alias("attempt"), F.col("worker").alias("actor"), data.alias("data"))


def append(log: DataFrame | None, inputs: DataFrame) -> DataFrame:
    """(ns, event_id, seq, ts, payload, prev_hash, hash) of new events behind the chains of a log.

    Only the last row of each namespace is read from the log.
    """
    if log is None:
        return chain(inputs)
    last = log.groupBy("ns").agg(F.max_by("hash", "seq").alias("head"), F.max("seq").alias("base"))
    return _built(inputs, last)
