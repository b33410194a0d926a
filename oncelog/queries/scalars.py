"""Queries on scalar functions, over columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import tables as T
from .registry import query


@query("SELECT o_orderkey AS id, '{\"a\":' || o_custkey || ',\"b\":' || to_json(o_orderpriority)::VARCHAR || ',\"z\":null}' AS canonical FROM orders")
def canonical_json(spark, sf):
    o = T.read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), S.canonical_object(z=F.lit(None).cast("string"), b=S.json_string(F.col("o_orderpriority")), a=F.col("o_custkey")).alias("canonical"))


@query("""SELECT event_id, '{"a":[' || event_id || ',{"b":null,"c":"x"}],"m":{"user":' || user_id || ',"zone":true},"z":' || json(props)::VARCHAR || '}' AS canonical FROM events
    UNION ALL SELECT -event_id, NULL FROM events""")
def canonical_nested(spark, sf):
    """JSON texts of some depth, members out of order, and texts that are no JSON."""
    e = T.read(spark, sf, "events")
    text = F.concat(F.lit('{ "z" : '), "props", F.lit(', "m": {"zone": true, "user": '), "user_id", F.lit('}, "a" : ['), "event_id", F.lit(', {"c":"x","b":null}]}'))
    odd = F.concat(F.lit('{"a": NaN, "b": '), "event_id", F.lit("}"))
    return e.select("event_id", S.canonical_json(text).alias("canonical")).unionAll(e.select((-F.col("event_id")).alias("event_id"), S.canonical_json(odd)))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def sha256_hex(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", S.sha256_hex(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT o_orderkey AS id, sha256('{\"customer\":' || o_custkey || ',\"order\":' || o_orderkey || '}') AS key FROM orders")
def idempotency_key(spark, sf):
    o = T.read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), S.idempotency_key(S.canonical_object(order=F.col("o_orderkey"), customer=F.col("o_custkey"))).alias("key"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN sha256(props) END AS fp FROM events")
def fingerprint(spark, sf):
    e = T.read(spark, sf, "events")
    return e.select("event_id", S.fingerprint(F.when(F.col("event_type") != "error", F.col("props"))).alias("fp"))


@query("SELECT event_id, replace(replace(rtrim(to_base64(encode(props)), '='), '+', '-'), '/', '_') AS encoded, props AS decoded FROM events")
def b64url_roundtrip(spark, sf):
    x = T.read(spark, sf, "events").select("event_id", S.base64url(F.col("props").cast("binary")).alias("encoded"))
    return x.select("event_id", "encoded", F.decode(S.base64url_decode(F.col("encoded")), "UTF-8").alias("decoded"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2048 THEN 'omitted' ELSE 'stored' END AS class, octet_length(encode(text)) AS bytes FROM documents")
def result_size_class(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", S.result_class(F.col("text"), 2_048).alias("class"), F.octet_length("text").cast("long").alias("bytes"))


_HEX = "substr(sha256(o_orderkey::VARCHAR), {}, {})"


@query(f"""SELECT o_orderkey AS id, lower(lpad(substr(h, 1, 8), 8, '0')) || '-' || substr(h, 9, 4) || '-7' || {_HEX.format(1, 3)} || '-' || substr('89ab', (('0x' || {_HEX.format(4, 1)})::INTEGER % 4) + 1, 1) || {_HEX.format(5, 3)} || '-' || {_HEX.format(8, 12)} AS uuid
    FROM (SELECT *, lpad(lower(to_hex(epoch_us(o_orderdate) // 1000)), 12, '0') AS h FROM orders)""")  # fmt: skip
def uuidv7_ids(spark, sf):
    """Version 7 ids whose random bits come from a digest of the order's key."""
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    bits = lambda at, n: F.conv(digest.substr(at, n), 16, 10).cast("long")
    low = bits(4, 1).bitwiseAND(3) * (1 << 60) + bits(5, 15)
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.uuidv7(T.epoch_ms(F.col("o_orderdate")), bits(1, 3), low).alias("uuid"))


_U = "(('0x' || substr(sha256(l_orderkey::VARCHAR || ':' || l_linenumber), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _u():
    return F.conv(F.sha2(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), 256).substr(1, 8), 16, 10).cast("double") / 4294967296.0


@query(f"SELECT l_orderkey, l_linenumber, floor({_U} * least(10000.0::DOUBLE, 200 * pow(2.0::DOUBLE, l_linenumber)))::BIGINT AS delay_ms FROM lineitem")
def backoff_delays(spark, sf):
    return T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor(S.backoff_ms(_u(), F.col("l_linenumber"))).alias("delay_ms"))


@query(f"SELECT l_orderkey, l_linenumber, floor(least(300000.0::DOUBLE, 30000 * pow(2.0::DOUBLE, l_linenumber - 1)) * (0.8::DOUBLE + 0.4::DOUBLE * {_U}) + 0.5)::BIGINT AS open_ms FROM lineitem")
def open_interval(spark, sf):
    return T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.open_interval_ms(F.col("l_linenumber"), _u()).alias("open_ms"))


@query("""SELECT event_id, CASE user_id % 4 WHEN 0 THEN (user_id % 50) * 1000 WHEN 1 THEN greatest(0, epoch_us(TIMESTAMP '2024-03-01 10:20:30') // 1000 - epoch_us(ts) // 1000) WHEN 2 THEN NULL ELSE 120000 END::BIGINT AS wait_ms FROM events""")
def retry_after(spark, sf):
    """Retry-After headers of several kinds: digits, an HTTP date, rubbish, and an odd case of the name."""
    e = T.read(spark, sf, "events")
    kind = (F.col("user_id") % 4).cast("int")
    bag = (
        F.when(kind == 0, F.create_map(F.lit("retry-after"), (F.col("user_id") % 50).cast("string")))
        .when(kind == 1, F.create_map(F.lit("Retry-After"), F.lit("Fri, 01 Mar 2024 10:20:30 GMT")))
        .when(kind == 2, F.create_map(F.lit("Retry-After"), F.lit("soon")))
        .otherwise(F.create_map(F.lit("RETRY-AFTER"), F.lit("120")))
    )
    return e.withColumn("bag", bag).select("event_id", S.retry_after_ms(S.header(F.col("bag"), "retry-after"), T.epoch_ms(F.col("ts"))).alias("wait_ms"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'indeterminate' WHEN event_type = 'error' THEN 'indeterminate' WHEN user_id % 3 = 0 THEN 'retryable' ELSE 'failed' END AS meaning FROM events")
def classify_outcomes(spark, sf):
    e = T.read(spark, sf, "events")
    return e.select("event_id", S.classify(F.col("user_id") % 5 == 0, F.col("event_type") == "error", F.when(F.col("user_id") % 3 == 0, "retryable")).alias("meaning"))


@query("SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts, value, props, event_type FROM events")
def schema_types(spark, sf):
    """Ids and times are numbers, never strings."""
    e = T.read(spark, sf, "events")
    return e.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), T.epoch_ms(F.col("ts")).alias("ts"), F.col("value").cast("double"), "props", "event_type")


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def state_snapshot(spark, sf):
    """A snapshot written and restored through the shared folder."""
    from ..sources.snapshots import restore, save

    path = save(T.read(spark, sf, "events").select("event_type", "user_id"), "events")
    return restore(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
