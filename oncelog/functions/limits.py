"""Defaults of the contract, free of Spark, so that worker functions can carry them."""

#: Defaults of the contract.
LEASE_MS, DEADLINE_MS, RETENTION_MS, MAX_RESULT_BYTES, MAX_CONTEXT_BYTES, MAX_KEY = 30_000, 60_000, 604_800_000, 65_536, 32_768, 200
RETRY_ATTEMPTS, RETRY_BASE_MS, RETRY_CAP_MS, RETRY_AFTER_CAP_MS = 3, 200, 10_000, 60_000
BUDGET_START, BUDGET_CAP, BUDGET_DEPOSIT, BUDGET_COST = 30, 100, 1, 10
WINDOW_SIZE, THRESHOLD, MIN_SAMPLES, OPEN_MS, MAX_OPEN_MS, PROBE_MS = 20, 0.5, 5, 30_000, 300_000, 30_000
POLL_MS, GATE_POLL_MS, GATE_POLL_FACTOR, GATE_POLL_CAP_MS, CLAIM_LEASE_MS, CLAIM_LIMIT = 25, 1_000, 1.5, 60_000, 30_000, 10
