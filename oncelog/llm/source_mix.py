"""Mixing sources to target weights by weighted sampling without replacement.

Sources, ordered by code point with null last, have weights 3, 1, 2, repeating. They
share ``budget`` times all words by weight, but no target exceeds ``max_epochs`` times
its source; the excess is shared again by weight until none does. Because shares only
grow while they are shared again, the result is min(cap, weight * level) for one level,
found from the sources sorted by cap / weight.

A target of e whole epochs and a rest takes every document e times; the rest goes to
documents in the order of exponential keys -ln(u) / quality (Efraimidis and Spirakis),
u being a hash of doc_id, until their prefix sum of words meets it. The last document
taken is cut there, so that a source's words meet its target to the nearest word.

Prefix sums never gather a source in one task: keys fall into ``BUCKETS`` buckets by their
rank under exp(-key), the totals of a source's buckets tell in which one its budget ends,
and only that one is sorted. What comes out is one row for each source, the document where
its budget is cut; every other document is judged by comparing its key with that row.

Defined cases: a null text has size 0; a null source is a source of its own; a null
doc_id hashes as an empty string; rows that repeat a doc_id are separate documents whose
keys tie and are ordered by size, and where equal sizes tie at the cut too, they share what
is left evenly, to the whole word; sources without words take none; without labels every
quality is neutral; other columns of the input are ignored by the plan of the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, fresh, materialize, table

WEIGHTS, BUDGET, MAX_EPOCHS, BUCKETS = (3, 1, 2), 1.5, 2, 4_096
#: Sampling weight of a document by its quality label; NEUTRAL where it has none.
QUALITY, NEUTRAL = {1: 2.0, 0: 0.5}, 1.0


def size_of(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    caps = total.select("source", "source_size", weight.cast("double").alias("weight")).withColumn("cap", (MAX_EPOCHS * F.col("source_size")).cast("double"))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing))
    level = (BUDGET * F.sum("source_size").over(everything) - before) / open_weight
    steps = caps.select("*", level.alias("level"), (F.col("cap") / F.col("weight")).alias("ratio"), F.row_number().over(rank).alias("rn"))
    # the level that holds is that of the first source which it leaves below its cap
    final = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("rn"))).over(everything)
    return steps.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * final), F.col("cap")).alias("target"))


def with_keys(docs: DataFrame, quality: DataFrame | None, key: str) -> DataFrame:
    """docs with a column ``key``: the exponential key, scaled by the quality label of (doc_id, quality)."""
    weight, extra = F.lit(NEUTRAL), []
    if quality is not None:
        extra = fresh([*docs.columns, key], "of", "label")
        best = quality.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(extra[0])).agg(F.max("quality").cast("int").alias(extra[1]))
        docs = docs.join(best.hint("merge"), docs["doc_id"] == best[extra[0]], "left")
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv)), F.col(extra[1])), F.lit(NEUTRAL))
    digits = F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return docs.withColumn(key, -F.log(u) / weight).drop(*extra)


def _spot(key: Column, doc_id: Column, size: Column) -> Column:
    """A document's place in the order of its source; null ids come first."""
    return F.struct(key.alias("key"), F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("id"), size.alias("size"))


def cuts(keyed: DataFrame) -> DataFrame:
    """One row for each source of (doc_id, source, size, key): its target, whole epochs, and where the rest is cut.

    ``cut`` is the place of the last document taken, ``left`` the words taken from the ``n`` documents of that place.
    """
    goal = targets(keyed).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialize(goal.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "goal")
    spots = keyed.select("source", "size", F.floor(BUCKETS * (1 - F.exp(-F.col("key")))).cast("int").alias("bucket"), _spot(F.col("key"), F.col("doc_id"), F.col("size")).alias("cut"))
    totals = spots.groupBy("source", "bucket").agg(F.sum("size").alias("own"))
    base = F.sum("own").over(Window.partitionBy("source").orderBy("bucket")) - F.col("own")
    starts = totals.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "own", base.alias("base"))
    last = starts.join(goal.select("source", "rest"), F.col("_s").eqNullSafe(F.col("source"))).where((F.col("base") < F.col("rest")) & (F.col("rest") <= F.col("base") + F.col("own"))).drop("source")
    last = materialize(last, "last")
    inside = spots.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).groupBy("source", "rest", "base", "cut").agg(F.count(F.lit(1)).alias("n"))
    all_ = F.col("n") * F.col("cut.size")
    before = F.col("base") + F.sum(all_).over(Window.partitionBy("source").orderBy("cut")) - all_
    found = inside.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + all_))
    found = found.select(F.col("source").alias("_s"), "cut", "n", (F.col("rest") - F.col("before")).alias("left"))
    return goal.join(found, goal["source"].eqNullSafe(found["_s"]), "left").drop("_s")


def _taken(spot: Column, size: Column, cut: Column) -> Column:
    """How many words the mix takes of a document; ``cut`` is a struct of its source's row."""
    rest = F.when(spot < cut["cut"], size).when(spot == cut["cut"], F.floor(cut["left"] / cut["n"])).otherwise(F.lit(0))
    return (cut["epochs"] * size + F.coalesce(rest, F.lit(0))).cast("long")


def mix(sized: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document of (doc_id, source, size)."""
    keyed = with_keys(sized.select("doc_id", "source", "size"), quality, "key")
    goal = materialize(cuts(keyed).select(F.struct("*").alias("g")), "cuts")
    both = keyed.join(goal, keyed["source"].eqNullSafe(F.col("g.source")))
    taken = _taken(_spot(F.col("key"), F.col("doc_id"), F.col("size")), F.col("size"), F.col("g"))
    return both.select("doc_id", keyed["source"], "size", "g.source_size", "g.target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, the last one cut to its words.

    A column n_chars, where there is one, follows the cut.
    """
    sized = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    own, size, key, take, copy = fresh(docs.columns, "own", "size", "key", "take", "copy")
    goal = materialize(cuts(with_keys(sized, quality, "key")).select(F.struct("*").alias(own)), "cuts")
    rows = with_keys(docs.withColumn(size, size_of(F.col("text"))), quality, key)
    rows = rows.join(goal, rows["source"].eqNullSafe(F.col(f"{own}.source")))
    rows = rows.withColumn(take, _taken(_spot(F.col(key), F.col("doc_id"), F.col(size)), F.col(size), F.col(own))).where(F.col(take) > 0)
    count = F.ceil(F.col(take) / F.col(size)).cast("int")
    each = rows.select(*docs.columns, size, take, F.explode(F.sequence(F.lit(1), count)).alias(copy))
    part = F.col(take) - (F.col(copy) - 1) * F.col(size)
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    shorter = part < F.col(size)
    each = each.withColumn("text", F.when(shorter, F.array_join(F.slice(pieces, F.lit(1), part.cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.when(shorter, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return each.select(*docs.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; labels give the quality weights."""
    sized = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    out = mix(sized, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size FROM documents
), total AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM total
), leveled AS (
  SELECT *, cap / weight AS ratio, row_number() OVER o AS rn,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), goal AS (
  SELECT source, source_size, least(cap, weight * (SELECT min_by(level, rn) FROM leveled WHERE level <= ratio)) AS target FROM leveled
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goal
), keyed AS (
  SELECT s.*, -ln((('0x' || substr(sha256(coalesce(s.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM sized s LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) q ON q.doc_id = s.doc_id
), ranked AS (
  SELECT *, count(*) OVER t AS n, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size * count(*) OVER t AS before
  FROM keyed WINDOW t AS (PARTITION BY source, key, doc_id, size)
)
SELECT r.doc_id, r.size::BIGINT AS size, g.source_size, g.target,
       (g.epochs * r.size + floor(least(r.n * r.size, greatest(0, round(g.target - g.epochs * g.source_size) - r.before)) / r.n))::BIGINT AS taken
FROM ranked r JOIN split g ON r.source IS NOT DISTINCT FROM g.source
"""
