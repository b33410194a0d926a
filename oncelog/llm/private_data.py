"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over each whole text finds anchors: at-signs, URL
schemes, plus signs before digits, digits beside a dot, a separator or a digit, and
words that announce an account. A deterministic parser around each anchor expands it to
the left and right and validates what it finds. Kinds of the contract (``BASE``) are
the leftmost non-overlapping matches of their patterns, dropped without a retry where
validation fails; ``url``, ``iban``, ``account`` and ``secret`` are added by the method.

Defined cases: a null text is empty; offsets are code points, ends exclusive; spans of
different kinds may overlap; ties in the start are ordered by kind as listed; rows are
independent, so repeated rows and doc_ids give repeated results; other columns pass
through ``mask`` untouched.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_DIGIT = frozenset(string.digits)
_PHONE = frozenset(string.digits + " ().-")
_URL_STOP = frozenset(" \t\n\r\x0b\x0c<>\"'`|\\^{}")
#: Words that announce an account, an identity or a secret, in any case.
_CUES = (
    "account", "acct", "passport", "ssn", "social security", "tax id", "taxpayer", "vat id", "customer id", "client id", "member id", "employee id", "patient id", "policy", "licence", "license", "routing",
    "konto", "kontonummer", "kundennummer", "ausweis", "steuernummer", "compte", "passeport", "cuenta", "pasaporte", "dni", "nie", "bsn", "codice fiscale",
)
_SECRETS = ("akia", "api_key", "apikey", "api-key", "api key", "access_key", "access key", "private_key", "client_secret", "password", "passwd", "passphrase", "pwd", "secret", "token", "credential", "passwort", "contraseña")
#: Lengths of account numbers of the standard by country.
_IBAN_LENGTHS = {
    "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
Span = tuple[int, int]


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    add = lambda word, kind: kinds.setdefault(word, set()).add(kind)
    add("@", "email")
    for scheme in ("http://", "https://", "ftp://"):
        add(scheme, "url")
    for x in string.digits:
        add(f"+{x}", "phone")
        for y in string.digits:
            add(f"{x}.{y}", "ip")
            for gap in ("", " ", "-"):
                add(f"{x}{gap}{y}", "card")
            for z in string.ascii_lowercase:
                add(f"{z}{x}{y}", "iban")
    for cue in _CUES:
        add(cue, "account")
    for cue in _SECRETS:
        add(cue, "secret")
    for word, own in kinds.items():
        a.add_word(word, (len(word), tuple(sorted(own))))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """The text in lower case, character by character: every place stays where it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, free: int) -> Span | None:
    """Around an at-sign; the local part may not reach before ``free``."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _ip(text: str, at: int, free: int) -> tuple[Span, bool] | None:
    """Around a dot between digits: four runs of digits, and whether each is at most 255."""
    start = at
    while start > free and text[start - 1] in _DIGIT:
        start -= 1
    end, parts = _run(text, start, _DIGIT), []
    parts.append(text[start:end])
    while len(parts) < 4 and end < len(text) and text[end] == "." and (more := _run(text, end + 1, _DIGIT)) > end + 1:
        parts.append(text[end + 1 : more])
        end = more
    if len(parts) < 4:
        return None
    return (start, end), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def _card(text: str, at: int, free: int) -> tuple[Span, bool]:
    """From a digit: digits with at most one space or hyphen between two."""
    start = at
    while start > free and text[start - 1] in _DIGIT:
        start -= 1
    end = _run(text, start, _DIGIT)
    while end + 1 < len(text) and text[end] in " -" and text[end + 1] in _DIGIT:
        end = _run(text, end + 1, _DIGIT)
    digits = [int(c) for c in text[start:end] if c in _DIGIT]
    return (start, end), 12 <= len(digits) <= 19 and _luhn(digits)


def _luhn(digits: list[int]) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(odd) + sum(d * 2 - 9 * (d > 4) for d in even)) % 10 == 0


def _phone(text: str, at: int) -> tuple[Span, bool] | None:
    """From a plus sign: a digit, digits and separators, and a last digit."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 2 and text[end - 1] not in _DIGIT:
        end -= 1
    if end < at + 4:  # the pattern needs a digit, one character or more, and a digit
        return None
    return (at, end), 9 <= sum(c in _DIGIT for c in text[at:end]) <= 15


def _url(text: str, at: int) -> Span | None:
    end = at
    while end < len(text) and text[end] not in _URL_STOP:
        end += 1
    while text[end - 1] in ".,;:!?)]":
        end -= 1
    return (at, end) if end > text.index("://", at) + 3 else None


_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")


def _iban(text: str, at: int) -> Span | None:
    """From two capitals and two digits, with the check digits of the standard."""
    if at and text[at - 1].isalnum() or not (m := _IBAN.match(text, at)):
        return None
    end, length = m.end(), _IBAN_LENGTHS.get(text[at : at + 2])
    if length:  # a known country's number ends at its length, whatever follows
        places = [k for k in range(at, end) if text[k] != " "]
        if len(places) < length:
            return None
        end = places[length - 1] + 1
        if end < len(text) and text[end].isalnum():
            return None
    code = text[at:end].replace(" ", "")
    return (at, end) if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


_ACCOUNT = re.compile(r"(?i:[ ](?:no|nr|number|num|id|is|code))*[.:#=]{0,2}[ ]?((?=[A-Z0-9-]*[0-9]{4})[A-Z0-9][A-Z0-9-]{4,}[A-Z0-9])(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?[ ]?[:=][ ]?[\"']?([A-Za-z0-9+/_.=-]{7,}[A-Za-z0-9+/_=-])")
_ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")


def find(text: str, automaton) -> dict[str, list[Span]]:  # type: ignore[no-untyped-def]
    """Spans of each kind of a whole text, by start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    #: Where the next match of a kind may start: failing matches are used up too.
    free = dict.fromkeys(KINDS, 0)
    for last, (size, kinds) in automaton.iter(_lower(text)):
        first = last - size + 1
        for kind in kinds:
            if first < free[kind] and not (kind == "email" and last >= free[kind]):
                continue
            found: Span | None = None
            valid = True
            if kind == "email":
                found = _email(text, first, free[kind])
            elif kind == "ip":
                if got := _ip(text, first, free[kind]):
                    found, valid = got
            elif kind == "card":
                found, valid = _card(text, first, free[kind])
            elif kind == "phone":
                if got := _phone(text, first):
                    found, valid = got
            elif kind == "url":
                found = _url(text, first)
            elif kind == "iban":
                found = _iban(text, first - 1) if first and text[first - 1] in string.ascii_uppercase and text[first] in string.ascii_uppercase else None
            elif kind == "account":
                if (first == 0 or not text[first - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
                    found = m.span(1)
            elif size == 4 and text[first : last + 1] in ("AKIA", "akia"):
                found = m.span() if (m := _ACCESS_KEY.match(text, first)) else None
            elif m := _SECRET.match(text, last + 1):
                found = m.span(1)
            if found:
                free[kind] = found[1]
                if valid:
                    out[kind].append(found)
    return out


def _joined(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    rows = sorted((s, KINDS.index(k), e) for k in kinds for s, e in spans[k])
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the spans of the base kinds and all spans, as kind:start:end, and a count per kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            rows = [find(t.as_py(), automaton) for t in b.column(1)]
            columns = [b.column(0)] + [pa.array([len(r[k]) for r in rows], pa.int64()) for k in KINDS]
            columns += [pa.array([_joined(r, kinds) for r in rows], pa.string()) for kinds in (BASE, KINDS)]
            yield pa.record_batch(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, f"doc_id long, {counts}, base_spans string, spans string")


def mask_text(text: str, automaton) -> str:  # type: ignore[no-untyped-def]
    """The text with every span replaced by its kind; of overlapping spans the leftmost, then longest, stays."""
    spans = sorted((s, -e, k) for k, own in find(text, automaton).items() for s, e in own)
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = -e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by placeholders; null stays null."""

    @F.pandas_udf("string")
    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton()
        for texts in parts:
            yield texts.map(lambda t: t if t is None else mask_text(t, automaton))

    return docs.withColumn("text", masked("text"))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    personal = sum((F.col(f"n_{k}") for k in KINDS if k != "url"), F.lit(0).cast("long"))
    return out.select("doc_id", *(f"n_{k}" for k in BASE), digest.alias("base_sha256"), "spans", *(f"n_{k}" for k in KINDS[len(BASE) :]), personal.alias("n_personal"))
