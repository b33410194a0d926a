"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Texts become typed words: lower-cased, without punctuation at the edges, with numbers,
units beside numbers and names replaced by ``#num``, ``#unit`` and ``#name``. A name is a
capitalised word that no sentence end or line break precedes. A template window is
``WINDOW`` consecutive typed words; its hash is joined with those of the benchmark, where a
window with names stands twice, typed and with the names as words: copies whose case was
changed have no names to see.

Windows that match at one offset between a document and an item vote together, and so do
those at offsets nearby, behind an edit, and runs of three anywhere: the item is found where
at least ``SHARE`` of its windows do. As a window of placeholders alone
proves nothing, the windows of a hit must also differ, and the slots must agree: at the
offset, each value of a slot in the item stands for one value in the document wherever it
recurs (a re-parameterised question replaces 7 by 12 everywhere). Items shorter than a
window are matched as one window of their own length.

The benchmark is never assumed to be small: Spark broadcasts its windows only where their
measured size, known from a written table, is under its threshold, and otherwise joins
by sorted hashes. Windows that many items share are rows like any other.

Defined cases: null or empty texts have no windows and are clean; a null doc_id is
compared like any other value; rows that repeat a doc_id are one document with respect
to the result (its hits are joined) and are kept or dropped together; an empty benchmark
or table gives no hits; other columns pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

WINDOW, SHARE = 5, 0.8
#: Units of measure that follow a number.
UNITS = "km cm mm kg mg lb oz ml kb mb gb ms hz kmh mph usd eur percent minutes minute hours hour seconds second days day weeks week months month years year dollars dollar euros euro meters meter metres metre miles mile litres liters grams pounds degrees"


#: Marks of slots in words: names and units; numbers show themselves.
_NAME, _UNIT = "#", "~"


def marked_words(text: Column) -> Column:
    """Lower-case words of a text; names and units carry their mark, values are kept."""
    text = F.translate(text, _NAME + _UNIT, "  ")
    text = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}][,;]?\x20)(\p{Lu}\p{Ll}+)", _NAME + "$1")
    text = F.lower(text)
    text = F.regexp_replace(text, r"(?<=\p{L})['\u2019](?=\p{L})|(?<=[0-9])[.,:](?=[0-9])", "")
    text = F.regexp_replace(text, rf"[^\p{{L}}\p{{M}}\p{{N}}{_NAME}]+", " ")
    text = F.regexp_replace(text, rf"(?<=[0-9]\x20)({UNITS.replace(' ', '|')})(?![^\x20])", _UNIT + "$1")
    return F.filter(F.split(text, " "), lambda w: w != "")


def _is_slot(w: Column) -> Column:
    return w.substr(1, 1).isin(_NAME, _UNIT, *"0123456789")


def _typed(w: Column) -> Column:
    first = w.substr(1, 1)
    return F.when(first == _NAME, "#name").when(first == _UNIT, "#unit").when(first.isin(*"0123456789"), "#num").otherwise(w)


def _windows(hashes: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words, by position; none where there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - size)
    each = F.transform(starts, lambda i: F.xxhash64(F.lit(size), *(F.get(hashes, i + k) for k in range(size))))
    return F.when(F.size(hashes) >= size, each).otherwise(F.array().cast("array<long>"))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(_typed(w)))


def _unnamed_hashes(words: Column) -> Column:
    """Hashes of the typed words where names are words like any other."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w.substr(1, 1) == _NAME, w.substr(F.lit(2), F.length(w))).otherwise(_typed(w))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item, words, size, pos, h, n_windows: the windows that tell an item, in one or two forms.

    Those of at least two words that are no slots are used, all where an item has none.
    ``item`` tells rows apart that repeat an item_id with other words.
    """
    items = benchmark.select("item_id", marked_words(text_or_empty()).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"])
    items = items.withColumn("size", F.least(F.lit(WINDOW), F.size("words"))).withColumn("hashes", _word_hashes(F.col("words"))).withColumn("unnamed", _unnamed_hashes(F.col("words")))
    by_size = lambda name: F.coalesce(*(F.when(F.col("size") == k, _windows(F.col(name), k)) for k in range(1, WINDOW + 1)))
    forms = F.zip_with(by_size("hashes"), by_size("unnamed"), lambda a, b: F.array_distinct(F.array(a, b)))
    each = items.withColumn("all", forms).select("item_id", "item", "words", "size", F.posexplode("all").alias("pos", "forms"))
    literal = F.size(F.filter(F.slice("words", F.col("pos") + 1, F.col("size")), lambda w: ~_is_slot(w))) >= 2
    own = Window.partitionBy("item")  # the windows of one item
    told = each.withColumn("told", literal).withColumn("n_told", F.count_if("told").over(own)).withColumn("n_all", F.count(F.lit(1)).over(own))
    used = told.where(F.col("told") | (F.col("n_told") == 0))
    return used.select("item_id", "item", "words", "size", "pos", F.explode("forms").alias("h"), F.when(F.col("n_told") > 0, F.col("n_told")).otherwise(F.col("n_all")).alias("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, share, reparameterised: the items that documents hold."""
    docs = docs.select("doc_id", "text")
    told = materialize(benchmark_windows(benchmark), "benchmark")
    sizes = [r[0] for r in told.select("size").distinct().collect()]  # at most WINDOW values
    lookup = told.select("h", F.struct("item", "pos", "n_windows").alias("at"))
    hashed = docs.select("doc_id", _word_hashes(marked_words(text_or_empty())).alias("hashes"))
    found = None
    for k in sizes:
        own = hashed.select("doc_id", F.posexplode(_windows(F.col("hashes"), k)).alias("p", "h"))
        own = own.join(lookup, "h").select("doc_id", "p", "at")
        found = own if found is None else found.unionAll(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, share double, reparameterised boolean")
    offset = F.col("p") - F.col("at.pos")
    runs = found.groupBy("doc_id", "at.item", "at.n_windows", offset.alias("off")).agg(
        F.count_distinct("at.pos").alias("n"), F.min("at.pos").alias("lo"), F.max("at.pos").alias("hi")
    )
    # an offset holds a whole item, or its part before or after an edit; what is short counts beside the longest
    best = Window.partitionBy("doc_id", "item")
    near = F.abs(F.col("off") - F.max_by("off", "n").over(best)) <= WINDOW
    enough = F.sum("n").over(best) >= share * F.col("n_windows")
    runs = runs.withColumn("near", near).withColumn("enough", enough).where(F.col("enough") & (F.col("near") | (F.col("n") >= F.least(F.lit(3), F.col("n_windows")))))
    hits = runs.groupBy("doc_id", "item", "n_windows").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "off", "lo", "hi")).alias("runs"))
    hits = materialize(hits.where(F.col("n") >= share * F.col("n_windows")), "hits")
    texts = docs.join(hits.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    texts = texts.select(F.col("doc_id").alias("_id"), marked_words(text_or_empty()).alias("doc_words"))
    items = told.select("item", "item_id", "words", "size").dropDuplicates(["item"])
    both = hits.join(items, "item").join(texts, F.col("doc_id").eqNullSafe(F.col("_id")))

    def slots(run: Column) -> Column:
        at = F.sequence(run["lo"], run["hi"] + F.col("size") - 1)
        pairs = F.transform(at, lambda p: F.struct(F.get("words", p).alias("i"), F.get("doc_words", p + run["off"]).alias("d")))
        return F.filter(pairs, lambda x: x["i"].isNotNull() & x["d"].isNotNull() & _is_slot(x["i"]) & _is_slot(x["d"]))

    def agree(run: Column) -> Column:
        """Whether enough of the item's slot values stand for one value each."""
        pairs = F.array_distinct(slots(run))
        values = F.array_distinct(F.transform(pairs, lambda x: x["i"]))
        once = F.filter(values, lambda v: F.size(F.filter(pairs, lambda x: x["i"] == v)) == 1)
        return F.size(once) >= share * F.size(values)

    kept = F.filter("runs", agree)
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda a, r: a + r["n"])
    changed = F.exists(kept, lambda r: F.exists(slots(r), lambda x: x["i"] != x["d"]))
    out = both.withColumn("told", total).withColumn("reparameterised", changed).where(F.col("told") >= share * F.col("n_windows"))
    return out.groupBy("doc_id", "item_id").agg(F.least(F.lit(1.0), F.max(F.col("told") / F.col("n_windows"))).alias("share"), F.max("reparameterised").alias("reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item; all columns as they were."""
    # written first: Spark then knows its size, and shuffles the texts only where it is too large to broadcast
    hit = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that holds benchmark items."""
    hits = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",")
    return hits.groupBy("doc_id").agg(names.alias("items"), F.count(F.lit(1)).alias("n_items"), F.max("share").alias("best_share"), F.max("reparameterised").alias("reparameterised"))
