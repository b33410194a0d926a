"""Folding whole runs: what deliveries, gate decisions and resumers of one intent leave behind.

A log has one row for each command of an intent: at, n (its place among equals), op, who,
seen (the time on that worker's own clock), value, ms, needs, quiet. The fold keeps the
effect, the gate and the downstream ledger of the intent, and emits audit events as they
are earned, so that their order is that of the log:

``claim``     opens the effect, parks an expired lease, replays, waits, or follows ``value``
              (fail, reclaim, gate) on a parked effect; ``needs`` one who holds the gate
``call``      an attempt downstream, by the owner alone: ok, timeout (landed, answer lost),
              error, retried (an error that another attempt follows), lost (the owner gave up on it)
``starved``   the retry budget denies another attempt
``complete``  the owner's terminal write; ``value`` is the status
``open``, ``decide``, ``take``, ``ack``  a gate's life; a decision past the expiry finds it timed out

A ``quiet`` command is one whose process died before it could tell anybody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMAND = "struct<at:bigint,n:int,op:string,who:string,seen:bigint,value:string,ms:bigint,needs:boolean,quiet:boolean>"
_STATE = {
    "status": "string", "owner": "string", "lease_end": "bigint", "since": "bigint", "waiting": "int", "deliveries": "bigint", "attempts": "bigint", "landed": "bigint", "reported": "bigint", "replays": "bigint",
    "parked_at": "bigint", "called_at": "bigint", "reclaimed": "boolean", "gate": "string", "expires_at": "bigint", "decided_at": "bigint", "loser": "string", "holder": "string", "until": "bigint", "processed_at": "bigint",
    "durations": "array<bigint>", "events": "array<string>",
}
TERMINAL = ("succeeded", "failed", "indeterminate")


def _made(values: dict[str, Column]) -> Column:
    return F.struct(*(values[name].cast(kind).alias(name) for name, kind in _STATE.items()))


def _step(s: Column, c: Column) -> Column:
    keep = {name: s[name] for name in _STATE}
    word = lambda name, when=None: F.when(~c["quiet"] & (F.lit(True) if when is None else when), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    told = lambda *more: F.concat(s["events"], *more)
    op = lambda name: c["op"] == name
    none = F.lit(None)

    holds = F.coalesce(s["holder"] == c["who"], F.lit(False))
    may = op("claim") & (~c["needs"] | holds)
    flying, parked = F.coalesce(s["status"] == "in_flight", F.lit(False)), F.coalesce(s["status"] == "indeterminate", F.lit(False))
    over = flying & (s["lease_end"] < c["seen"])
    again = parked & (c["value"] == "reclaim")
    done = F.coalesce(s["status"] == "succeeded", F.lit(False))
    asks = (over | parked) & (c["value"] == "gate") & s["gate"].isNull()
    own = F.coalesce(s["owner"] == c["who"], F.lit(False)) & flying

    started = {"status": F.lit("in_flight"), "owner": c["who"], "lease_end": c["seen"] + c["ms"], "since": c["at"], "deliveries": s["deliveries"] + 1}
    claimed = keep | started | {"reclaimed": F.coalesce(s["reclaimed"], F.lit(False)) | again, "parked_at": none, "events": told(word("effect.claimed"))}
    gated = {"gate": F.when(asks, "pending").otherwise(s["gate"]), "expires_at": F.when(asks, c["at"] + c["ms"]).otherwise(s["expires_at"])}
    answered = keep | gated | {
        "deliveries": s["deliveries"] + 1,
        "status": F.when(over, "indeterminate").otherwise(s["status"]), "owner": F.when(over, none).otherwise(s["owner"]), "parked_at": F.when(over, c["at"]).otherwise(s["parked_at"]), "loser": F.when(over, s["owner"]).otherwise(s["loser"]),
        "waiting": s["waiting"] + F.when(flying & ~over, 1).otherwise(0),
        "reported": s["reported"] + F.when(done, 1).otherwise(0), "replays": s["replays"] + F.when(done, 1).otherwise(0),
        "durations": F.when(flying & ~over, s["durations"]).otherwise(F.concat(s["durations"], F.array(F.lit(0).cast("bigint")))),
        "events": told(word("effect.indeterminate", over), word("effect.replayed", done), word("gate.opened", asks)),
    }
    called = keep | {
        "attempts": s["attempts"] + 1, "landed": s["landed"] + F.when(c["value"].isin("ok", "timeout", "lost"), 1).otherwise(0), "called_at": c["at"],
        "events": told(word("effect.attempt_failed", c["value"] == "retried")),
    }
    starved = keep | {"events": told(word("retry.budget_exhausted"))}
    good = c["value"] == "succeeded"
    waited = F.when(good, F.array_repeat(F.lit("effect.replayed"), s["waiting"])).otherwise(F.array().cast("array<string>"))
    completed = keep | {
        "status": c["value"], "owner": none, "lease_end": none, "waiting": F.lit(0), "parked_at": F.when(c["value"] == "indeterminate", c["at"]),
        "reported": s["reported"] + F.when(good, 1 + s["waiting"]).otherwise(0), "replays": s["replays"] + F.when(good, s["waiting"]).otherwise(0),
        "durations": F.concat(s["durations"], F.array_repeat(c["at"] - s["since"], s["waiting"] + 1)),
        "events": told(F.array(F.concat(F.lit("effect."), c["value"])), waited),
    }
    # the owner that lost its lease is told so when it wants to complete, and so are those that wait
    refused = keep | {"durations": F.concat(s["durations"], F.array_repeat(c["at"] - s["since"], s["waiting"] + 1)), "waiting": F.lit(0), "loser": none}

    opened = keep | {"gate": F.lit("pending"), "expires_at": c["at"] + c["ms"], "events": told(word("gate.opened"))}
    open_ = F.coalesce(s["gate"] == "pending", F.lit(False))
    late = open_ & (c["at"] >= s["expires_at"])
    decided = keep | {
        "gate": F.when(late, "timed_out").when(open_, c["value"]).otherwise(s["gate"]), "decided_at": F.when(late, s["expires_at"]).when(open_, c["at"]).otherwise(s["decided_at"]),
        "events": told(word("gate.timed_out", late), word("gate.decided")),
    }
    free = s["processed_at"].isNull() & (s["holder"].isNull() | (s["until"] < c["at"])) & s["gate"].isin("approved", "rejected", "timed_out")
    taken = keep | {"holder": c["who"], "until": c["at"] + c["ms"], "events": told(word("gate.claimed"))}
    acked = keep | {"processed_at": c["at"], "events": told(word("gate.resumed"))}

    return (
        F.when(may & (s["status"].isNull() | again), _made(claimed)).when(may, _made(answered)).when(op("call") & own, _made(called)).when(op("starved") & own, _made(starved))
        .when(op("complete") & own, _made(completed)).when(op("complete") & F.coalesce(s["loser"] == c["who"], F.lit(False)), _made(refused))
        .when(op("open") & s["gate"].isNull(), _made(opened)).when(op("decide") & s["gate"].isNotNull(), _made(decided))
        .when(op("take") & F.coalesce(free, F.lit(False)), _made(taken)).when(op("ack") & holds & s["processed_at"].isNull(), _made(acked)).otherwise(_made(keep))
    )


def fold(logs: DataFrame, *keys: str) -> DataFrame:
    """keys and the state that each log (an array of commands) ends in; no shuffle, as a row has its log."""
    zero = {name: F.lit(None) for name in _STATE} | dict.fromkeys(("waiting", "deliveries", "attempts", "landed", "reported", "replays"), F.lit(0)) | dict.fromkeys(("durations", "events"), F.array())
    ordered = F.array_sort(F.col("log").cast(f"array<{COMMAND}>"))
    # a generator gives all fields of the state at once, so that the fold stands once in the plan
    return logs.select(*keys, F.inline(F.array(F.aggregate(ordered, _made(zero), _step))))


def collected(commands: DataFrame, *keys: str) -> DataFrame:
    """Logs of (keys, command columns), one for each key: for command tables, after one shuffle."""
    names = [part.split(":")[0] for part in COMMAND[7:-1].split(",")]
    return commands.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("log"))


def violations(runs: DataFrame, *keys: str, resumed: Column | None = None, slack_ms: int = 1_000) -> DataFrame:
    """keys, rule: the invariants that a run breaks.

    I1 no effect lands twice, and a reported success landed once; I2 no success without an
    effect; I3 a parked effect reports no success and is not tried again; I4 every gate is
    decided in time; I5 resumed work landed once; I7 terminal states and replays have
    their events; I8 no event follows a terminal one but a replay.
    """
    resumed = F.lit(False) if resumed is None else resumed
    has = lambda word: F.coalesce(F.array_contains("events", word), F.lit(False))
    count = lambda word: F.size(F.filter("events", lambda e: e == word))
    parked = (F.col("status") == "indeterminate") & ~F.coalesce("reclaimed", F.lit(False))
    ended = F.filter("events", lambda e: e.isin("effect.claimed", "effect.attempt_failed", *(f"effect.{t}" for t in TERMINAL)))
    final = F.filter(F.sequence(F.lit(1), F.size(ended)), lambda i: F.get(ended, i - 1).isin("effect.succeeded", "effect.failed") & (i < F.size(ended)))
    broken = {
        "I1": (F.col("landed") > 1) | ((F.col("reported") > 0) & (F.col("landed") > 1)),
        "I2": (F.col("reported") > 0) & (F.col("landed") == 0),
        "I3": parked & ((F.col("reported") > 0) | F.coalesce(F.col("called_at") > F.col("parked_at"), F.lit(False))),
        "I4": (F.col("gate") == "pending") | F.coalesce(F.col("decided_at") > F.col("expires_at") + slack_ms, F.lit(False)),
        "I5": resumed & (F.col("landed") != 1),
        "I7": (F.col("status").isin(*TERMINAL) & ~has(F.concat(F.lit("effect."), "status"))) | (count("effect.replayed") < F.col("replays")),
        "I8": (F.size(ended) > 1) & (F.size(final) > 0),
    }
    rules = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), rule) for rule, bad in broken.items())), lambda r: r.isNotNull())
    return runs.select(*keys, F.explode(rules).alias("rule"))
