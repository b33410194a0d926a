"""Parameters of scenario cases, free of Spark, so that worker functions can carry them."""

from __future__ import annotations

from ..functions import limits

CASE = (
    "case string, scenario string, seed int, intents int, variant string, deliveries_low int, deliveries_high int, error double, timeout double, "
    "overrides array<string>, latency_low bigint, latency_high bigint, tries int, crashes int"
)
#: The scenarios' default plans and sizes.
DEFAULTS = {
    "duplicate-delivery": {"intents": 6, "deliveries_low": 2, "deliveries_high": 5},
    "timeout-then-success": {"intents": 6, "overrides": ["timeout"]},
    "crash-mid-effect": {"intents": 3},
    "crash-before-effect": {"intents": 3},
    "crash-mid-gate": {"intents": 2},
    "retry-storm": {"intents": 40, "error": 0.3},
    "clock-skew": {"intents": 4, "latency_low": 100, "latency_high": 100},
    "slow-downstream": {"intents": 4, "latency_low": 5_000, "latency_high": 90_000},
    "out-of-order-decision": {"intents": 6},
}
PLAIN = {"variant": "", "deliveries_low": 1, "deliveries_high": 1, "error": 0.0, "timeout": 0.0, "overrides": [], "latency_low": 0, "latency_high": 0, "tries": limits.RETRY_ATTEMPTS, "crashes": 1}


def case(name: str, seed: int, **given) -> dict:  # type: ignore[no-untyped-def]
    """One case with the defaults of its scenario."""
    return PLAIN | DEFAULTS[name] | {"case": f"{name}:{seed}", "scenario": name, "seed": seed} | given
