"""What callers may make of an error code: whether to retry, and whether the effect may have landed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code, retryable, indeterminate.
CODES = [
    ("E_CONFIG", False, False), ("E_KEY_CONFLICT", False, False), ("E_INDETERMINATE", False, True), ("E_EFFECT_FAILED", False, False), ("E_CIRCUIT_OPEN", True, False), ("E_RETRY_BUDGET", False, False), ("E_DEADLINE", False, False),
    ("E_LEASE_LOST", False, True), ("E_WAIT_TIMEOUT", True, False), ("E_GATE_REJECTED", False, False), ("E_GATE_TIMEOUT", False, False), ("E_BAD_TOKEN", False, False), ("E_STORE", True, False), ("E_RESULT_TOO_LARGE", False, False),
]


def retryable(code: Column) -> Column:
    """Null where there is no error."""
    return F.when(code.isNotNull(), code.isin(*(c for c, again, _ in CODES if again)))


def indeterminate(code: Column, in_flight: Column | None = None) -> Column:
    """``in_flight``: the deadline or the store failed while the effect was under way."""
    own = code.isin(*(c for c, _, lost in CODES if lost))
    if in_flight is not None:
        own = own | (code.isin("E_DEADLINE", "E_STORE") & in_flight)
    return F.when(code.isNotNull(), own)
