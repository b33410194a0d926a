"""Deterministic fault plans: every draw is a pure function of (seed, label).

FNV-1a over the label seeds a Mulberry32 generator; both are public 32-bit algorithms,
written in 64-bit arithmetic that cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1


def multiply32(a: Column, b: Column | int) -> Column:
    """The low 32 bits of a product of two unsigned 32-bit numbers."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    low = a.bitwiseAND(0xFFFF) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(0xFFFF) * 65_536
    return (low + high).bitwiseAND(_MASK)


def fnv1a(label: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII label."""
    codes = F.transform(F.sequence(F.lit(1), F.length(label)), lambda i: F.ascii(F.substring(label, i, F.lit(1))).cast("long"))
    return F.aggregate(F.when(F.length(label) > 0, codes).otherwise(F.array().cast("array<long>")), F.lit(0x811C9DC5).cast("long"), lambda h, c: multiply32(h.bitwiseXOR(c), 0x01000193))


def _let(value: Column, body) -> Column:  # type: ignore[no-untyped-def]
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def mulberry32(seed: Column, draw: Column | int = 1) -> Column:
    """The draw-th number in [0, 1) of the generator with a seed."""
    draw = F.lit(draw).cast("long") if isinstance(draw, int) else draw.cast("long")
    one, odd = F.lit(1).cast("long"), F.lit(61).cast("long")
    shifted = lambda t, n: t.bitwiseXOR(F.shiftright(t, n))
    first = lambda a: multiply32(shifted(a, 15), a.bitwiseOR(one))
    second = lambda t: t.bitwiseXOR((t + multiply32(shifted(t, 7), t.bitwiseOR(odd))).bitwiseAND(_MASK))
    state = (seed + multiply32(draw, 0x6D2B79F5)).bitwiseAND(_MASK)
    last = _let(state, lambda a: _let(first(a), lambda t: _let(second(t), lambda x: shifted(x, 14))))
    return last.cast("double") / float(1 << 32)


def draw(seed: Column, label: Column) -> Column:
    return mulberry32(fnv1a(F.concat_ws(":", seed.cast("string"), label)))


def deliveries_for(seed: Column, intent: Column, low: int, high: int) -> Column:
    u = draw(seed, F.concat(F.lit("deliveries:"), intent))
    return F.greatest(F.lit(1), F.lit(low) + F.floor(u * (high - low + 1)).cast("int")) if high > low else F.lit(max(1, low))


def attempt_fault(seed: Column, intent: Column, attempt: Column, error: float, timeout: float, overrides: Column | None = None) -> Column:
    u = draw(seed, F.concat_ws(":", F.lit("fault"), intent, attempt.cast("string")))
    drawn = F.when(u < error, "error").when(u < error + timeout, "timeout").otherwise("ok")
    return drawn if overrides is None else F.coalesce(F.try_element_at(overrides, attempt.cast("int")), drawn)


def latency_for(seed: Column, intent: Column, attempt: Column, low: int, high: int) -> Column:
    u = draw(seed, F.concat_ws(":", F.lit("latency"), intent, attempt.cast("string")))
    return F.floor(low + u * (high - low) + 0.5).cast("long") if high > low else F.lit(low).cast("long")
