"""Logs of deliveries, gates, decisions, audit events and breaker outcomes as DataFrames.

The engine's inputs are append-only logs. Here they are derived from the star schema of
the test tables, with total orders, epoch milliseconds as longs and no wall-clock reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def epoch_ms(ts: Column) -> Column:
    return F.floor(epoch_us(ts) / 1000).cast("long")


def namespace(key: Column) -> Column:
    return F.concat(F.lit("ns"), (key % 5).cast("string"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ns, key, created_at, price: one row for every logical effect."""
    o = read(spark, sf_dir, "orders")
    return o.select(namespace(F.col("o_orderkey")).alias("ns"), F.col("o_orderkey").cast("string").alias("key"), epoch_ms(F.col("o_orderdate")).alias("created_at"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("order_status"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ns, key, delivery_no, ts, worker, fault, fp, latency_ms, qty: deliveries of intents in a total order.

    Those of one key lie in one partition, as the window that numbers them brings them there.
    """
    x = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = x.select("*", F.row_number().over(w).alias("n"))
    fault = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "N", "error").otherwise("timeout")
    return rows.select(
        namespace(F.col("l_orderkey")).alias("ns"),
        F.col("l_orderkey").cast("string").alias("key"),
        F.col("n").cast("long").alias("delivery_no"),
        epoch_ms(F.col("l_shipdate")).alias("ts"),
        F.when(F.col("n") % 2 == 1, "w1").otherwise("w2").alias("worker"),
        fault.alias("fault"),
        F.sha2(F.concat(F.lit('{"q":'), (F.col("l_suppkey") % 3).cast("string"), F.lit("}")), 256).alias("fp"),
        (F.col("l_quantity").cast("long") * 1000).alias("latency_ms"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.col("l_linestatus").alias("line_status"),
        F.concat(F.lit("h"), (F.col("l_suppkey") % 10).cast("string")).alias("actor"),
    )


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ns, key, created_at, expires_at, on_timeout: approval gates as opened."""
    i = intents(spark, sf_dir)
    timeout = F.substring("priority", 1, 1).cast("long") * 30 * DAY_MS
    return i.select(
        F.concat(F.lit("gate-"), "key").alias("id"), "ns", "key", "created_at", (F.col("created_at") + timeout).alias("expires_at"),
        F.when(F.col("order_status") == "P", "approve").otherwise("reject").alias("on_timeout"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, decision_no, ts, decision, actor: decisions in order of arrival."""
    return deliveries(spark, sf_dir).select(
        F.concat(F.lit("gate-"), "key").alias("id"), F.col("delivery_no").alias("decision_no"), "ts", F.when(F.col("line_status") == "F", "approved").otherwise("rejected").alias("decision"), "actor"
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ns, event_id, ts, subject_type, subject_key, type, attempt, actor, data: audit events to append."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("ns"), "event_id", epoch_ms(F.col("ts")).alias("ts"), F.lit("effect").alias("subject_type"), F.col("user_id").cast("string").alias("subject_key"),
        F.when(F.col("event_type") == "error", "effect.failed").otherwise("effect.succeeded").alias("type"), F.lit(None).cast("int").alias("attempt"), F.lit("engine").alias("actor"), F.col("props").alias("data"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """circuit, n, ts, ok, took: calls that feed circuit breakers, in order; took is null where no answer ever comes."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy(F.col("user_id") % 16).orderBy("ts", "event_id")
    return e.select(F.concat(F.lit("c"), (F.col("user_id") % 16).cast("string")).alias("circuit"), F.row_number().over(w).cast("long").alias("n"), epoch_ms(F.col("ts")).alias("ts"), (F.col("event_type") != "error").alias("ok"),
                    F.when(F.col("event_id") % 97 != 0, F.col("event_id") % 7 * 1_000).cast("long").alias("took"))


#: The same derivations for DuckDB, as common table expressions.
ORACLE = {
    "intents": """intents AS (SELECT 'ns' || (o_orderkey % 5) AS ns, o_orderkey::VARCHAR AS key, epoch_us(o_orderdate) // 1000 AS created_at,
        o_orderpriority AS priority, o_orderstatus AS order_status FROM orders)""",
    "deliveries": """numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
        deliveries AS (SELECT 'ns' || (l_orderkey % 5) AS ns, l_orderkey::VARCHAR AS key, n AS delivery_no, epoch_us(l_shipdate) // 1000 AS ts,
        CASE WHEN n % 2 = 1 THEN 'w1' ELSE 'w2' END AS worker, CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'error' ELSE 'timeout' END AS fault,
        sha256('{"q":' || (l_suppkey % 3) || '}') AS fp, l_quantity::BIGINT * 1000 AS latency_ms, l_quantity::BIGINT AS qty, l_linestatus AS line_status, 'h' || (l_suppkey % 10) AS actor FROM numbered)""",
    "gates": """gates AS (SELECT 'gate-' || key AS id, ns, key, created_at, created_at + substr(priority, 1, 1)::BIGINT * 30 * 86400000 AS expires_at,
        CASE WHEN order_status = 'P' THEN 'approve' ELSE 'reject' END AS on_timeout FROM intents)""",
    "decisions": """decisions AS (SELECT 'gate-' || key AS id, delivery_no AS decision_no, ts, CASE WHEN line_status = 'F' THEN 'approved' ELSE 'rejected' END AS decision, actor FROM deliveries)""",
    "audit": """audit AS (SELECT event_type AS ns, event_id, epoch_us(ts) // 1000 AS ts, 'effect' AS subject_type, user_id::VARCHAR AS subject_key,
        CASE WHEN event_type = 'error' THEN 'effect.failed' ELSE 'effect.succeeded' END AS type, NULL::INTEGER AS attempt, 'engine' AS actor, props AS data FROM events)""",
    "outcomes": """outcomes AS (SELECT 'c' || (user_id % 16) AS circuit, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS n, epoch_us(ts) // 1000 AS ts,
        event_type <> 'error' AS ok FROM events)""",
}
_NEEDS = {"gates": ["intents"], "decisions": ["deliveries"]}


def oracle(body: str, *names: str, more: str = "", recursive: bool = False) -> str:
    """SQL with the derivations that it names in front; ``more`` are further expressions."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    parts = [ORACLE[n] for n in wanted] + ([more] if more else [])
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + body
