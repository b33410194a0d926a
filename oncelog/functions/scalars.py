"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .limits import LEASE_MS, DEADLINE_MS, RETENTION_MS, MAX_RESULT_BYTES, MAX_CONTEXT_BYTES, MAX_KEY, RETRY_ATTEMPTS, RETRY_BASE_MS, RETRY_CAP_MS, RETRY_AFTER_CAP_MS, BUDGET_START, BUDGET_CAP, BUDGET_DEPOSIT, BUDGET_COST, WINDOW_SIZE, THRESHOLD, MIN_SAMPLES, OPEN_MS, MAX_OPEN_MS, PROBE_MS, POLL_MS, GATE_POLL_MS, GATE_POLL_FACTOR, GATE_POLL_CAP_MS, CLAIM_LEASE_MS, CLAIM_LIMIT  # noqa: F401

def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def json_string(s: Column) -> Column:
    """A JSON string literal."""
    inner = F.to_json(F.struct(F.coalesce(s, F.lit("")).alias("s")))
    return F.when(s.isNull(), F.lit("null")).otherwise(inner.substr(F.lit(6), F.length(inner) - 6))


def canonical_object(**members: Column) -> Column:
    """Canonical JSON of an object of fixed shape: members sorted by name, values already JSON texts."""
    parts: list[Column] = []
    for name in sorted(members):
        parts += [F.lit(("," if parts else "{") + f'"{name}":'), F.coalesce(members[name].cast("string"), F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def sha256_hex(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def idempotency_key(canonical: Column) -> Column:
    return sha256_hex(canonical)


def fingerprint(canonical: Column) -> Column:
    """Null where there is nothing to compare."""
    return F.when(canonical.isNotNull(), sha256_hex(canonical))


def base64url(b: Column) -> Column:
    """Unpadded base64 of the URL alphabet."""
    return F.translate(F.base64(b), "+/=\r\n", "-_")


def base64url_decode(s: Column) -> Column:
    """Bytes, or null where the text is malformed."""
    good = s.rlike("^[A-Za-z0-9_-]*$") & (F.length(s) % 4 != 1)
    padded = F.concat(F.translate(s, "-_", "+/"), F.repeat(F.lit("="), (4 - F.length(s) % 4) % 4))
    return F.when(good, F.unbase64(F.when(good, padded)))


def uuidv7(ms: Column, high: Column, low: Column) -> Column:
    """A version 7 UUID from milliseconds and 12 and 62 random bits."""
    t = F.lower(F.lpad(F.hex(ms), 12, "0"))
    a = F.lower(F.lpad(F.hex(high.bitwiseAND(0xFFF)), 3, "0"))
    b = F.lower(F.lpad(F.hex(low.bitwiseAND((1 << 62) - 1).bitwiseOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat_ws("-", t.substr(1, 8), t.substr(9, 4), F.concat(F.lit("7"), a), b.substr(1, 4), b.substr(5, 12))


def backoff_ms(u: Column, completed: Column) -> Column:
    return u * F.least(F.lit(float(RETRY_CAP_MS)), RETRY_BASE_MS * F.pow(F.lit(2.0), completed))


def retry_after_ms(raw: Column, now_ms: Column) -> Column:
    """Digits are seconds, an HTTP date counts from now and not below 0; null if neither."""
    date = F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    at = F.unix_millis(F.from_utc_timestamp(date, F.current_timezone()))
    return F.when(raw.rlike(r"^\d+$"), F.regexp_extract(raw, r"^(\d{1,12})$", 1).try_cast("long") * 1000).when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), at - now_ms))


def header(bag: Column, name: str) -> Column:
    """A header's value, whatever the case of its name."""
    return F.element_at(F.map_values(F.map_filter(bag, lambda k, v: F.lower(k) == name.lower())), 1)


def open_interval_ms(opens: Column, u: Column) -> Column:
    return round_half_up(F.least(F.lit(float(MAX_OPEN_MS)), OPEN_MS * F.pow(F.lit(2.0), opens - 1)) * (0.8 + 0.4 * u)).cast("long")


def result_class(result: Column, limit: int = MAX_RESULT_BYTES) -> Column:
    return F.when(F.octet_length(result) > limit, "omitted").otherwise("stored")


def classify(aborted: Column, indeterminate: Column, user: Column) -> Column:
    """What a throw means: our own abort, then a lost answer, then the user's word, else failed."""
    return F.when(aborted, "indeterminate").when(indeterminate, "indeterminate").otherwise(F.coalesce(user, F.lit("failed")))


@F.pandas_udf(StringType())
def hmac_sha256_hex(key: pd.Series, message: pd.Series) -> pd.Series:
    """HMAC-SHA256 of UTF-8 texts; null where either is."""
    return pd.Series([None if k is None or m is None else hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in zip(key, message, strict=True)], dtype="object")


@F.pandas_udf(BooleanType())
def same_digest(a: pd.Series, b: pd.Series) -> pd.Series:
    """A comparison in constant time."""
    return pd.Series([x is not None and y is not None and hmac.compare_digest(x, y) for x, y in zip(a, b, strict=True)])


def mint_token(gate_id: Column, exp_ms: Column, nonce: Column, secret: Column) -> Column:
    body = base64url(F.concat_ws(".", gate_id, exp_ms.cast("string"), nonce).cast("binary"))
    return F.concat_ws(".", body, hmac_sha256_hex(secret, body))


def token_is_valid(token: Column, secret: Column, gate_id: Column, now_ms: Column) -> Column:
    """The digest first, then the shape and the gate, then the expiry; one answer for any defect."""
    body, mac = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
    parts = F.split(base64url_decode(body).cast("string"), r"\.")
    fresh = F.try_element_at(parts, F.lit(2)).try_cast("long") >= now_ms
    return F.coalesce(same_digest(hmac_sha256_hex(secret, body), mac) & (F.size(parts) == 3) & (F.try_element_at(parts, F.lit(1)) == gate_id) & fresh, F.lit(False))


def token_code(token: Column, secret: Column, gate_id: Column, now_ms: Column) -> Column:
    """E_BAD_TOKEN for a token with any defect, else null."""
    return F.when(~token_is_valid(token, secret, gate_id, now_ms), "E_BAD_TOKEN")


def canonical_json(text: Column) -> Column:
    """Canonical JSON of a JSON text of any nesting: members sorted by name, no white space; null where it is no JSON (NaN and the like)."""
    return F.to_json(F.try_parse_json(text))


def ascii_text(b: Column) -> Column:
    """Bytes as text where all of them are ASCII, else an empty text."""
    text = F.try_validate_utf8(b.cast("string"))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise("")


def safe_message(message: Column, text: Column) -> Column:
    """An error's message, the text that was thrown, or a fixed phrase."""
    return F.coalesce(message, text, F.lit("unknown error"))


def percent(x: Column) -> Column:
    return F.concat(F.floor(100 * x + 0.5).cast("string"), F.lit(" %"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
