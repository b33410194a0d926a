"""Folding command logs of effects: claim, heartbeat, complete, reclaim and sweep.

A log has one row for each command: ns, key, n (its place), op, now, owner, fp, lease_ms,
retention_ms, reclaim, status, result. Commands of one key are folded in order of (now,
n); each gets an answer, and each key a record. The fold is an ordered pass (``ordered``):
the sorted commands of a key stream by, and only its record is kept, so that a key may
have any number of commands.

Within an Arrow batch the keys are folded side by side: the first commands of all keys as
arrays, then the second ones, and so on (``_step_all``). Where few keys have commands
left, these are folded one by one (``_step``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from .carry import ordered, shape_of, values

COMMAND = "ns string, key string, n long, op string, now long, owner string, fp string, lease_ms long, retention_ms long, reclaim boolean, status string, result string"
_KEY = "ns string, key string"
_RECORD = "status string, attempt long, owner string, lease_end long, fp string, created_at long, updated_at long, expires_at long, result string, code string"
_ANSWER = "n long, outcome string, status string, attempt long, expired boolean, code string"
_NONE = (None,) * 10
#: What all commands of deliveries share, where the defaults are not changed.
DELIVERED = {"lease_ms": S.LEASE_MS, "retention_ms": S.RETENTION_MS, "result": None}
#: So many keys at least are folded side by side; fewer cost less one by one.
_ABREAST = 32
#: Null among the whole numbers and codes of ``_step_all``; batches with numbers beyond _WIDE are folded one by one.
_NULL, _WIDE = -(1 << 63), 1 << 61
#: Strings that have the same codes in every batch, by column of the record or answer.
_STATUS = ("in_flight", "indeterminate")
_CODES = ("E_KEY_CONFLICT", "E_LEASE_LOST", "E_STORE")
_OPS = ("claim", "heartbeat", "complete", "sweep")
_OUTCOMES = ("claimed", "exists", "ok", "not_ok", "refused", "removed", "kept")


def _step(record: tuple, command: tuple) -> tuple[tuple, tuple]:
    """The record of a key after a command, and what the command is told; comparisons with a null do not hold."""
    ns, key, n, op, now, caller, asked, lease_ms, retention_ms, reclaim, ends, value = command
    status, attempt, owner, lease_end, fp, created_at, _, expires_at, result, code = record
    flying = status == "in_flight"
    if op == "claim":
        told = "E_KEY_CONFLICT" if status is not None and fp is not None and asked is not None and fp != asked else None
        lease = None if now is None or lease_ms is None else now + lease_ms
        if status is None:
            expires = None if now is None or retention_ms is None else now + retention_ms
            return ("in_flight", 1, caller, lease, asked, now, now, expires, None, None), (ns, key, n, "claimed", "in_flight", 1, False, told)
        if flying and lease_end is not None and now is not None and lease_end < now:
            return ("indeterminate", attempt, None, None, fp, created_at, now, expires_at, result, "E_LEASE_LOST"), (ns, key, n, "exists", "indeterminate", attempt, True, told)
        if reclaim and status == "indeterminate":
            return ("in_flight", attempt + 1, caller, lease, fp, created_at, now, expires_at, result, None), (ns, key, n, "claimed", "in_flight", attempt + 1, False, told)
        return record, (ns, key, n, "exists", status, attempt, False, told)
    held = flying and owner is not None and owner == caller
    if op == "heartbeat":
        if not held:
            return record, (ns, key, n, "not_ok", status, attempt, False, None)
        lease = None if now is None or lease_ms is None else now + lease_ms
        return ("in_flight", attempt, owner, lease, fp, created_at, now, expires_at, result, code), (ns, key, n, "ok", status, attempt, False, None)
    if op == "complete":
        if not held:
            return record, (ns, key, n, "refused", status, attempt, False, "E_STORE" if status is None else "E_LEASE_LOST")
        return (ends, attempt, None, None, fp, created_at, now, expires_at, value, None), (ns, key, n, "ok", ends, attempt, False, None)
    if op == "sweep":
        swept = status is not None and not flying and expires_at is not None and now is not None and expires_at <= now
        return (_NONE if swept else record), (ns, key, n, "removed" if swept else "kept", status, attempt, False, None)
    return record, (ns, key, n, None, status, attempt, False, None)


def _step_all(record: np.ndarray, command: np.ndarray) -> np.ndarray:
    """``_step`` for one command of each of many keys: changes their records in place and returns the answers.

    Rows of the arrays are the columns of the record, the command from op on, and the
    answer from outcome on; strings are codes.
    """
    status, attempt, owner, lease_end, fp, created_at, updated_at, expires_at, result, code = record
    op, now, caller, asked, lease_ms, retention_ms, reclaim, ends, value = command
    claims, beats, completes, sweeps = (op == k for k in range(4))
    fresh, flying, timed = status == _NULL, status == 0, now != _NULL
    conflict = claims & ~fresh & (fp != _NULL) & (asked != _NULL) & (fp != asked)
    opened = claims & fresh
    lost = claims & flying & timed & (lease_end != _NULL) & (lease_end < now)
    again = claims & (status == 1) & (reclaim == 1)
    held = flying & (owner != _NULL) & (owner == caller)
    beat, done = beats & held, completes & held
    swept = sweeps & ~fresh & ~flying & timed & (expires_at != _NULL) & (expires_at <= now)
    taken, freed = opened | again, lost | done
    lease = np.where(timed & (lease_ms != _NULL), now + lease_ms, _NULL)

    answer = np.full((5, len(op)), _NULL)
    answer[0] = np.select([claims, beats, completes, sweeps], [np.where(taken, 0, 1), np.where(held, 2, 3), np.where(held, 2, 4), np.where(swept, 5, 6)], _NULL)
    answer[3] = lost
    answer[4][conflict] = 0
    answer[4][completes & ~held] = np.where(fresh, 2, 1)[completes & ~held]

    np.copyto(expires_at, np.where(timed & (retention_ms != _NULL), now + retention_ms, _NULL), where=opened)
    np.copyto(fp, asked, where=opened)
    np.copyto(created_at, now, where=opened)
    result[opened] = _NULL
    np.copyto(result, value, where=done)
    np.copyto(updated_at, now, where=taken | freed | beat)
    attempt[opened] = 1
    attempt[again] += 1
    np.copyto(owner, caller, where=taken)
    np.copyto(lease_end, lease, where=taken | beat)
    status[taken] = 0
    status[lost] = 1
    np.copyto(status, ends, where=done)
    code[taken | done] = _NULL
    code[lost] = 1
    for column in (owner, lease_end):
        column[freed] = _NULL
    answer[1], answer[2] = status, attempt  # a swept record is told as it was
    record[:, swept] = _NULL
    return answer


class _Batch:
    """A batch of sorted commands as arrays of whole numbers, and the strings behind their codes."""

    def __init__(self, batch: pa.RecordBatch, last: tuple | None, record: tuple):
        """``last`` is the key (key, ns) of the row before, ``record`` what it has so far."""
        self.batch, n = batch, batch.num_rows
        self.status, self.codes, self.outcomes, self.owners, self.fps, self.results = _book(_STATUS), _book(_CODES), _book(_OUTCOMES), {}, {}, {}
        self.books = (self.status, None, self.owners, None, self.fps, None, None, None, self.results, self.codes)
        op, now, owner, fp, lease_ms, retention_ms, reclaim, status, result = batch.columns[3:]
        self.commands = np.stack(
            [_coded(op, _book(_OPS)), _numbers(now), _coded(owner, self.owners), _coded(fp, self.fps), _numbers(lease_ms), _numbers(retention_ms), _numbers(reclaim), _coded(status, self.status), _coded(result, self.results)]
        )
        opens = np.ones(n, dtype=bool)
        opens[1:] = _changes(batch.column(0)) | _changes(batch.column(1))
        self.starts = np.flatnonzero(opens)
        self.sizes = np.diff(np.append(self.starts, n))
        self.continues = last is not None and last == (batch.column(1)[0].as_py(), batch.column(0)[0].as_py())
        self.records = np.full((len(_NONE), len(self.starts)), _NULL)
        #: Records of keys that are folded one by one; Python's numbers have no bounds.
        self.apart: dict[int, tuple] = {0: record} if self.continues else {}

    @staticmethod
    def _encode(row: tuple, books: tuple) -> list[int]:
        return [_NULL if v is None else int(v) if book is None else book.setdefault(v, len(book)) for v, book in zip(row, books, strict=True)]

    def record(self, k: int) -> tuple:
        """The record of the batch's k-th key."""
        if k in self.apart:
            return self.apart[k]
        names = [None if book is None else list(book) for book in self.books]
        return tuple(None if v == _NULL else v if own is None else own[v] for v, own in zip(self.records[:, k].tolist(), names, strict=True))

    def states(self) -> np.ndarray:
        """The records of all keys, as codes."""
        for k, record in self.apart.items():
            self.records[:, k] = self._encode(record, self.books)
        return self.records

    def fold(self) -> np.ndarray:
        """Folds all commands into the keys' records and returns their answers."""
        answers = np.full((5, self.batch.num_rows), _NULL)
        order = np.argsort(-self.sizes, kind="stable")
        starts, sizes = self.starts[order], self.sizes[order]
        wide = any(((row > _WIDE) | ((row < -_WIDE) & (row != _NULL))).any() for row in self.commands)
        wide |= any(isinstance(v, int) and abs(v) > _WIDE for record in self.apart.values() for v in record)
        if len(order) >= _ABREAST and not wide:
            records = self.states()[:, order]
            self.apart.clear()
        done = 0
        while not wide and (m := int(np.searchsorted(-sizes, -done))) >= _ABREAST:
            at = starts[:m] + done
            answers[:, at] = _step_all(records[:, :m], self.commands[:, at])
            done += 1
        if done:
            self.records[:, order] = records
        for k in order[: np.searchsorted(-sizes, -done)].tolist():
            self._fold_one(k, done, answers)
        return answers

    def _fold_one(self, k: int, done: int, answers: np.ndarray) -> None:
        """Folds the k-th key's commands from its ``done``-th on one by one."""
        begin, size = int(self.starts[k]) + done, int(self.sizes[k]) - done
        books = (self.outcomes, self.status, None, None, self.codes)
        record, told = self.record(k), []
        for row in zip(*map(values, self.batch.slice(begin, size).columns), strict=True):
            record, answer = _step(record, row)
            told.append(self._encode(answer[3:], books))
        answers[:, begin : begin + size] = np.array(told, dtype=np.int64).T
        self.apart[k] = record


def _book(names: tuple[str, ...]) -> dict[str, int]:
    return {name: k for k, name in enumerate(names)}


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), _NULL).to_numpy()


def _coded(column: pa.Array, book: dict[str, int]) -> np.ndarray:
    """The codes of strings; those that the book lacks are entered."""
    coded = column.dictionary_encode()
    codes = np.array([*(book.setdefault(v, len(book)) for v in coded.dictionary.to_pylist()), _NULL])
    return codes[pc.fill_null(coded.indices, len(codes) - 1).to_numpy()]


def _decoded(codes: np.ndarray, book: dict[str, int]) -> pa.Array:
    return pa.array(list(book), pa.string()).take(_nullable(codes))


def _nullable(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.int64(), mask=numbers == _NULL)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    return pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _folded(batches: Iterator[pa.RecordBatch], shape: pa.Schema, fixed: dict) -> Iterator[tuple[_Batch, np.ndarray]]:
    last, record = None, _NONE
    for b in batches:
        if b.num_rows:
            own = [pa.repeat(pa.scalar(fixed[f.name], f.type), b.num_rows) if f.name in fixed else b.column(f.name) for f in shape]
            b = pa.record_batch(own, names=shape.names)
            own = _Batch(b, last, record)
            answers = own.fold()
            last, record = (b.column(1)[b.num_rows - 1].as_py(), b.column(0)[b.num_rows - 1].as_py()), own.record(len(own.starts) - 1)
            yield own, answers


def _log(commands: DataFrame, clustered: bool, fixed: dict) -> DataFrame:
    """The commands as ``_step`` takes them, but for columns that are fixed, in their total order."""
    fields = [f for f in StructType.fromDDL(COMMAND) if f.name not in fixed]
    rows = commands.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))
    return ordered(rows, ["key", "ns"], ["now", "n", *(f.name for f in fields if f.name not in ("ns", "key", "now", "n"))], clustered)


def records(commands: DataFrame, clustered: bool = False, fixed: dict | None = None) -> DataFrame:
    """ns, key and record of every key that has one: it was claimed, and not swept.

    With ``clustered``, the commands of a key already lie in one partition and are not
    shuffled. ``fixed`` are columns that have one value in all commands: they are not sorted along.
    """
    schema = f"{_KEY}, {_RECORD}"
    shape, taken, fixed = shape_of(schema), shape_of(COMMAND), fixed or {}

    def columns(ns: pa.Array, key: pa.Array, states: np.ndarray, books: tuple) -> pa.RecordBatch:
        kept = states[0] != _NULL
        fields = [_nullable(x[kept]) if book is None else _decoded(x[kept], book) for x, book in zip(states, books, strict=True)]
        return pa.record_batch([c.cast(f.type) for c, f in zip([ns.filter(pa.array(kept)), key.filter(pa.array(kept)), *fields], shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last key of a batch goes on in the next one or ends there
        for own, _ in _folded(batches, taken, fixed):
            if before is not None and not own.continues:
                yield columns(*before)
            heads = pa.array(own.starts)
            ns, key = own.batch.column(0).take(heads), own.batch.column(1).take(heads)
            yield columns(ns[:-1], key[:-1], own.states()[:, :-1], own.books)
            before = (ns[-1:], key[-1:], own.records[:, -1:], own.books)
        if before is not None:
            yield columns(*before)

    return _log(commands, clustered, fixed).mapInArrow(run, schema)


def answers(commands: DataFrame, clustered: bool = False, fixed: dict | None = None) -> DataFrame:
    """ns, key, n, outcome, status, attempt, expired, code: what every command is told; ``clustered`` and ``fixed`` as in ``records``."""
    schema = f"{_KEY}, {_ANSWER}"
    shape, taken, fixed = shape_of(schema), shape_of(COMMAND), fixed or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, (outcome, status, attempt, expired, code) in _folded(batches, taken, fixed):
            told = [_decoded(outcome, own.outcomes), _decoded(status, own.status), _nullable(attempt), pa.array(expired == 1), _decoded(code, own.codes)]
            yield pa.record_batch([c.cast(f.type) for c, f in zip([*own.batch.columns[:3], *told], shape, strict=True)], schema=shape)

    return _log(commands, clustered, fixed).mapInArrow(run, schema)


def from_deliveries(deliveries: DataFrame, lease_ms: int = S.LEASE_MS, retention_ms: int = S.RETENTION_MS) -> DataFrame:
    """Deliveries as commands: each claims, beats once where it lasts, and completes unless its answer is lost.

    Every third key's later claims reclaim what is parked. Commands stay in the partition of their delivery.
    """
    timeout, lasts = F.col("fault") == "timeout", F.col("latency_ms") > lease_ms // 3
    places = lambda *p: F.array(*map(F.lit, p))
    each = F.when(timeout & lasts, places(0, 1)).when(timeout, places(0)).when(lasts, places(0, 1, 2)).otherwise(places(0, 2))
    rows = deliveries.select("ns", "key", "delivery_no", "ts", "worker", "fault", "fp", "latency_ms", F.explode(each).alias("place"))
    claims, beats = F.col("place") == 0, F.col("place") == 1
    return rows.select(
        "ns", "key", (F.col("delivery_no") * 4 + F.col("place")).alias("n"),
        F.when(claims, "claim").when(beats, "heartbeat").otherwise("complete").alias("op"),
        F.when(claims, F.col("ts")).when(beats, F.col("ts") + lease_ms // 3).otherwise(F.col("ts") + F.col("latency_ms")).alias("now"),
        F.concat(F.col("worker"), F.lit(":"), F.col("delivery_no").cast("string")).alias("owner"), "fp", F.lit(lease_ms).cast("long").alias("lease_ms"), F.lit(retention_ms).cast("long").alias("retention_ms"),
        (F.col("key").cast("long") % 3 == 0).alias("reclaim"), F.when(F.col("place") == 2, F.when(F.col("fault") == "ok", "succeeded").otherwise("failed")).alias("status"), F.lit(None).cast("string").alias("result"),
    )
