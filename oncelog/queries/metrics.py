"""Metrics and invariants over ledgers, attempts and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import effects as E
from ..operators import gates as G
from ..operators import invariants as I
from ..operators import metrics as M
from ..sources import tables as T
from .effects import _EFFECTS, _WIN, effects
from .gates import _NOW, _STATES
from .registry import query

_LEDGER = "ledger AS (SELECT * FROM deliveries WHERE fault IN ('ok', 'timeout'))"
_COUNTS = f"{_LEDGER}, counts AS (SELECT key, count(*) AS n FROM ledger GROUP BY key), reports AS (SELECT key, count(*) FILTER (fault = 'ok') AS reported FROM deliveries GROUP BY key)"


def _counts(spark, sf):
    return M.ledger_counts(M.ledger(T.deliveries(spark, sf)), "key")


def _reports(spark, sf):
    return T.deliveries(spark, sf).groupBy("key").agg(F.count_if(F.col("fault") == "ok").alias("reported"))


@query(T.oracle("SELECT * FROM counts", "deliveries", more=_COUNTS))
def ledger_counts(spark, sf):
    return _counts(spark, sf)


@query(T.oracle("SELECT coalesce(sum(greatest(0, n - 1)), 0)::BIGINT AS duplicates FROM counts", "deliveries", more=_COUNTS))
def duplicate_effects(spark, sf):
    c = _counts(spark, sf)
    return c.agg(M.duplicate_effects(c).alias("duplicates"))


@query(T.oracle("SELECT * FROM reports", "deliveries", more=_COUNTS))
def success_reports(spark, sf):
    return _reports(spark, sf)


@query(T.oracle("SELECT ns, count(DISTINCT key) AS intents, count(DISTINCT CASE WHEN fault = 'ok' THEN key END) AS succeeded, floor(count(DISTINCT CASE WHEN fault = 'ok' THEN key END) * 10000.0::DOUBLE / count(DISTINCT key) + 0.5) / 1e4 AS rate FROM deliveries GROUP BY ns", "deliveries"))
def intent_success_rate(spark, sf):
    x = T.deliveries(spark, sf).groupBy("ns", "key").agg(F.max((F.col("fault") == "ok").cast("int")).alias("ok"))
    n, ok = F.count(F.lit(1)), F.sum("ok")
    return x.groupBy("ns").agg(n.alias("intents"), ok.alias("succeeded"), M.round4(ok / n).alias("rate"))


@query(T.oracle("SELECT ns, count(*) FILTER (status = 'indeterminate') AS parked, count(*) AS total FROM effects GROUP BY ns", "deliveries", more=f"{_WIN}, {_EFFECTS}"))
def fail_closed_rate(spark, sf):
    """Over the final statuses of effects, told by their prefix."""
    return _finals(spark, sf).where(F.col("id").startswith("effect:")).groupBy("ns").agg(F.count_if(F.col("status") == "indeterminate").alias("parked"), F.count(F.lit(1)).alias("total"))


@query(T.oracle("SELECT i.ns, i.n AS intents, coalesce(a.n, 0) AS attempts FROM (SELECT ns, count(*) AS n FROM intents GROUP BY ns) i LEFT JOIN (SELECT ns, count(*) AS n FROM deliveries GROUP BY ns) a USING (ns)", "intents", "deliveries"))
def amplification(spark, sf):
    return I.amplification(T.deliveries(spark, sf), T.intents(spark, sf), "ns", gate=0.0)


@query(T.oracle("SELECT a.ns, p50, p99 FROM (SELECT ns, latency_ms AS p50 FROM places WHERE rn - 1 = least(n - 1, (0.5::DOUBLE * n)::DOUBLE // 1)) a JOIN (SELECT ns, latency_ms AS p99 FROM places WHERE rn - 1 = least(n - 1, floor(0.99::DOUBLE * n))) b USING (ns)",
    "deliveries", more="places AS (SELECT ns, latency_ms, row_number() OVER (PARTITION BY ns ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY ns) AS n FROM deliveries)").replace("(0.5::DOUBLE * n)::DOUBLE // 1", "floor(0.5::DOUBLE * n)"))
def latency_percentiles(spark, sf):
    d = T.deliveries(spark, sf).select("ns", "latency_ms")
    return M.percentile(d, "latency_ms", 0.5, "ns").join(M.percentile(d, "latency_ms", 0.99, "ns"), "ns")


@query(T.oracle("""SELECT ns, floor(100 * (count(*) FILTER (fault = 'ok') * 1.0::DOUBLE / count(*)) + 0.5)::BIGINT || ' %' AS ok, format('{:,}', sum(latency_ms)::BIGINT) AS latency,
    floor(count(*) FILTER (fault = 'error') * 1.0::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS errors FROM deliveries GROUP BY ns""", "deliveries"))  # fmt: skip
def report_figures(spark, sf):
    """Figures as a report prints them: a share in per cent, a number in groups of three, a rate to four places."""
    share = lambda f: F.count_if(F.col("fault") == f) / F.count(F.lit(1))
    return T.deliveries(spark, sf).groupBy("ns").agg(S.percent(share("ok")).alias("ok"), S.thousands(F.sum("latency_ms")).alias("latency"), M.round4(share("error")).alias("errors"))


@query(T.oracle("SELECT ns, count(*) AS deliveries, count(*) FILTER (fault = 'ok') AS ok, count(*) FILTER (fault = 'error') AS error, count(*) FILTER (fault = 'timeout') AS timeout, sum(latency_ms)::BIGINT AS latency FROM deliveries GROUP BY GROUPING SETS ((ns), ())", "deliveries"))
def report_metrics(spark, sf):
    n = lambda f: F.count_if(F.col("fault") == f).alias(f)
    return T.deliveries(spark, sf).rollup("ns").agg(F.count(F.lit(1)).alias("deliveries"), n("ok"), n("error"), n("timeout"), F.sum("latency_ms").alias("latency"))


@query(T.oracle("""SELECT i.key, coalesce(c.n, 0) AS n, coalesce(r.reported, 0) AS reported FROM intents i LEFT JOIN counts c USING (key) LEFT JOIN reports r USING (key)
    WHERE coalesce(c.n, 0) > 1 OR (coalesce(r.reported, 0) > 0 AND coalesce(c.n, 0) <> 1)""", "intents", "deliveries", more=_COUNTS))  # fmt: skip
def i1_exactly_once(spark, sf):
    """Raw deliveries without deduplication break it for every intent that landed twice."""
    return I.exactly_once(T.intents(spark, sf), _counts(spark, sf), _reports(spark, sf))


@query(T.oracle("SELECT key, reported FROM reports r WHERE reported > 0 AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.key = r.key AND l.qty > 10)", "deliveries", more=_COUNTS))
def i2_phantom_success(spark, sf):
    """Reported successes without an entry in a ledger that lost its small quantities."""
    return I.phantom_success(_reports(spark, sf), M.ledger(T.deliveries(spark, sf)).where("qty > 10"))


@query(T.oracle("SELECT d.key, d.delivery_no, w.ts + 30000 AS parked_at, d.ts FROM deliveries d JOIN win w USING (ns, key) WHERE w.fault = 'timeout' AND d.ts > w.ts + 30000", "deliveries", more=_WIN))
def i3_fail_closed(spark, sf):
    d = T.deliveries(spark, sf)
    parked = E.claim_winners(d).where("fault = 'timeout'").select("key", (F.col("ts") + 30_000).alias("parked_at"))
    return I.fail_closed(parked, d)


@query(T.oracle("SELECT key, coalesce(n, 0) AS n FROM (SELECT DISTINCT key FROM intents WHERE order_status = 'P') i LEFT JOIN counts USING (key) WHERE coalesce(n, 0) <> 1", "intents", "deliveries", more=_COUNTS))
def i5_resume_once(spark, sf):
    return I.resumed_once(T.intents(spark, sf).where("order_status = 'P'"), _counts(spark, sf))


@query(T.oracle("SELECT i.ns, i.n AS intents, a.n AS attempts FROM (SELECT ns, count(*) AS n FROM intents GROUP BY ns) i JOIN (SELECT ns, count(*) AS n FROM deliveries GROUP BY ns) a USING (ns) WHERE a.n > 1.5 * i.n", "intents", "deliveries"))
def i6_amplification(spark, sf):
    return I.amplification(T.deliveries(spark, sf), T.intents(spark, sf), "ns")


_STATUS = "CASE fault WHEN 'ok' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'indeterminate' END"


@query(T.oracle("""SELECT key, delivery_no AS n, before, status FROM (SELECT key, delivery_no, status, lag(status) OVER (PARTITION BY key ORDER BY delivery_no) AS before FROM moves)
    WHERE (before IN ('succeeded', 'failed') AND status <> before) OR (before = 'indeterminate' AND status NOT IN ('indeterminate', 'in_flight'))""", "deliveries", more=f"moves AS (SELECT *, {_STATUS} AS status FROM deliveries)"))  # fmt: skip
def i8_monotonic(spark, sf):
    status = F.when(F.col("fault") == "ok", "succeeded").when(F.col("fault") == "error", "failed").otherwise("indeterminate")
    return I.monotonic(T.deliveries(spark, sf).select("key", F.col("delivery_no").alias("n"), status.alias("status")))


_STATUSES = f"{_WIN}, {_EFFECTS}, {_STATES}, finals AS (SELECT ns, 'effect:' || key AS id, status FROM effects UNION ALL SELECT ns, 'gate:' || id, status FROM states)"


def _finals(spark, sf):
    """ns, id, status of all effects and gates; their kind is the prefix of the id."""
    e = effects(spark, sf).select("ns", F.concat(F.lit("effect:"), "key").alias("id"), "status")
    g = G.resolve(T.gates(spark, sf), T.decisions(spark, sf), F.lit(_NOW)).select("ns", F.concat(F.lit("gate:"), "id").alias("id"), "status")
    return e.unionAll(g)


@query(T.oracle("SELECT ns, id, status, row_number() OVER (PARTITION BY ns ORDER BY id) AS place FROM finals", "deliveries", "gates", "decisions", more=_STATUSES))
def final_statuses(spark, sf):
    """Effects and gates with their final status and their place in the order of names, a row for each."""
    w = Window.partitionBy("ns").orderBy("id")
    return _finals(spark, sf).select("ns", "id", "status", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT 'orders' AS relation, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders UNION ALL SELECT 'events', count(*), count(DISTINCT event_id) FROM events
    UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FROM lineitem""")  # fmt: skip
def uniqueness_checks(spark, sf):
    def one(name: str, *keys: str):
        per = T.read(spark, sf, name).groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        return per.agg(F.lit(name).alias("relation"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("keys")).select("relation", "n", "keys")

    return one("orders", "o_orderkey").unionAll(one("events", "event_id")).unionAll(one("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query(T.oracle("SELECT key, CASE WHEN length(key) = 0 OR length(key) > 4 THEN 'E_CONFIG' END AS code FROM intents", "intents"))
def invalid_specs(spark, sf):
    """Keys outside their allowed length, here at most four characters, are refused."""
    return T.intents(spark, sf).select("key", F.when(~F.length("key").between(1, 4), "E_CONFIG").alias("code"))


@query(T.oracle("SELECT ns, count(*) AS attempts, count(*) FILTER (fault <> 'error') AS landed FROM deliveries GROUP BY ns", "deliveries"))
def transport_ledger(spark, sf):
    return T.deliveries(spark, sf).groupBy("ns").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("fault") != "error").alias("landed"))


@query(T.oracle("SELECT d.ns, d.key, d.delivery_no FROM deliveries d LEFT JOIN crash c USING (worker) WHERE c.at IS NULL OR d.ts < c.at", "deliveries", more="crash AS (SELECT 'w2' AS worker, 800000000000 AS at)"))
def crash_filter(spark, sf):
    """Deliveries that a worker still takes: none from the moment it crashes."""
    crash = spark.createDataFrame([("w2", 800_000_000_000)], "worker string, at long")
    return T.deliveries(spark, sf).join(F.broadcast(crash), "worker", "left").where("at IS NULL OR ts < at").select("ns", "key", "delivery_no")


@query(T.oracle("SELECT ns, count(*) FILTER (ts BETWEEN 800000000000 AND 820000000000) AS refused, count(*) AS calls FROM deliveries GROUP BY ns", "deliveries"))
def store_outage(spark, sf):
    """Calls that find the store down, by namespace."""
    return T.deliveries(spark, sf).groupBy("ns").agg(F.count_if(F.col("ts").between(800_000_000_000, 820_000_000_000)).alias("refused"), F.count(F.lit(1)).alias("calls"))


@query(T.oracle("SELECT key, max(attempts) FILTER (true) AS attempts, arg_max(fault, attempts) AS last_fault FROM (SELECT key, fault, delivery_no AS attempts FROM tries) GROUP BY key", "deliveries",
    more="firsts AS (SELECT key, coalesce(min(delivery_no) FILTER (fault <> 'error'), 99) AS stop FROM deliveries WHERE delivery_no <= 3 GROUP BY key), tries AS (SELECT d.key, d.fault, d.delivery_no FROM deliveries d JOIN firsts f USING (key) WHERE d.delivery_no <= 3 AND d.delivery_no <= f.stop)"))
def retry_resolution(spark, sf):
    """Tries up to the first that is no error, three at most."""
    x = T.deliveries(spark, sf).where("delivery_no <= 3").groupBy("key").agg(F.min(F.when(F.col("fault") != "error", F.struct("delivery_no", "fault"))).alias("ends"), F.max(F.struct("delivery_no", "fault")).alias("last"))
    pick = F.coalesce("ends", "last")
    return x.select("key", pick["delivery_no"].alias("attempts"), pick["fault"].alias("last_fault"))
