"""Removing repeated passages with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. Every window is filed under its minimizer: the
least hash among its runs of ``GRAM`` words (the leftmost of equals), so equal windows
have the same minimizer at the same place. Consecutive windows of one minimizer form a
segment, about 22 windows in one row (gram, seg, doc, first, last), seg being the XXH3 hash
of the segment's words themselves, byte by byte.

The index is a log of immutable runs, bucketed and sorted by gram, each with one row per
distinct segment: its first document. A batch is reduced to distinct segments, merge-joined
with the runs by gram, and verified in two steps:

* a segment that the index or an earlier document of the batch has, of equal gram and
  words (64 bits each), is covered as a whole;
* where different segments share a gram in different documents, only part of them may
  agree: the windows of one copy of each are read back from the texts and compared by 128
  bits of XXH3 over their words, the first document of every window decides, and the
  windows found, as places within the segment, hold for all copies of the segment.

Then the batch's distinct segments become a new run; ``fanout`` runs are folded into one.
A passage that a third of all documents share is one row per map task before any shuffle.
All tables of a batch but its result are removed when it is done.

Order: documents of earlier batches come before those of later ones, and within a batch
smaller doc_ids come first. Defined cases: a null text has no words; texts under
``WINDOW`` words are never changed; a null doc_id comes last, and rows of equal doc_id
never remove each other's words; an empty table gives an empty result; other columns
are ignored by ``judge``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RunLog, WordBuffer, Workspace, mix64, table, text_or_empty

WINDOW, GRAM, FANOUT = 50, 8, 4
_LAST = (1 << 63) - 1
_SEGMENTS = "gram long, seg long, ord long, th long, a int, b int"
_RUN = "gram long, seg long, ord long, th long, a int, b int"
_BASE = 0x9E3779B97F4A7C15 | 1


class RangeHasher:
    """Hashes of value ranges by prefix sums of a polynomial modulo 2**64; they only choose minimizers."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        powers = np.cumprod(np.full(n, base, dtype=np.uint64))
        self.back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of width values, the place of its leftmost least one."""
    n = len(values) - width + 1
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        right = best[step : step + m] < best[:m]
        at = np.where(right, at[step : step + m], at[:m])
        best = np.where(right, best[step : step + m], best[:m])
        have += step
    return at[:n]


def _plain(texts: list[str]) -> WordBuffer:
    """The words of texts, one space between them: equal passages are equal ranges of bytes."""
    return WordBuffer([b" ".join(t.encode().split()) for t in texts])


def _segments(words: WordBuffer, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, gram hash, segment hash, first and last window of every segment of a buffer."""
    import xxhash

    hashes = words.word_hashes()
    if len(hashes) < window:
        return (np.empty(0, np.int64),) * 5
    over = RangeHasher(hashes, _BASE)
    at = np.arange(len(hashes) - gram + 1)
    grams = over(at, at + gram)
    least = _leftmost_minima(grams, window - gram + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    whole = np.flatnonzero(text[: len(hashes) - window + 1] == text[window - 1 :])  # windows within one text
    if not len(whole):
        return (np.empty(0, np.int64),) * 5
    place = least[whole]
    opens = np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(whole) != 1)))
    first, last = whole[opens], whole[np.append(np.flatnonzero(opens)[1:] - 1, len(whole) - 1)]
    place = place[opens]
    raw, digest = words.data.tobytes(), xxhash.xxh3_64_intdigest
    ranges = zip(words.starts[first].tolist(), words.ends[last + window - 1].tolist(), (place - first).tolist(), strict=True)
    seg = np.array([digest(raw[s:e], seed) for s, e, seed in ranges], dtype=np.uint64)
    base = words.first[text[first]]
    return text[first], grams[place].view(np.int64), seg.view(np.int64), first - base, last - base


def _batched(rows: Iterator[tuple], chars: int = 8_000_000) -> Iterator[list[tuple]]:
    """Groups of rows whose texts (the last field) are of bounded size; one text is never split."""
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += len(row[-1])
        if total >= chars:
            yield group
            group, total = [], 0
    if group:
        yield group


def _keyed(docs: DataFrame) -> DataFrame:
    """(ord, th, text): a row's place in the order and a hash that tells rows of one doc_id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        for group in _batched(rows):
            text, grams, segs, a, b = _segments(_plain([t for _, _, t in group]), window, gram)
            ords, ths = (np.array([r[k] for r in group], dtype=np.int64)[text] for k in (0, 1))
            yield pa.record_batch(
                [pa.array(x, pa.int64()) for x in (grams, segs, ords, ths)] + [pa.array(x.astype(np.int32)) for x in (a, b)],
                names=["gram", "seg", "ord", "th", "a", "b"],
            )

    return _keyed(docs).mapInArrow(run, _SEGMENTS)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, rank, gram, seg, at) of the wanted windows of (ord, th, text, wanted: list of (rank, gram, seg, a, b)); at counts from a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (1, 0)), strict=True))
        for group in _batched(rows, 4_000_000):
            words = _plain([t for *_, t in group])
            raw = words.data.tobytes()
            each = [(i, *w.values()) for i, (wanted, _) in enumerate(group) for w in wanted]
            text, rank, grams, segs, a, b = (np.array(x, dtype=np.int64) for x in zip(*each, strict=True))
            n = b - a + 1
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(words.first[text] + a, n) + start
            ranges = zip(words.starts[at].tolist(), words.ends[at + window - 1].tolist(), strict=True)
            both = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in ranges]), dtype="<i8").reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)] + [pa.array(np.repeat(x, n)) for x in (rank, grams, segs)] + [pa.array(start.astype(np.int32))],
                names=["h1", "h2", "rank", "gram", "seg", "at"],
            )

    return texts.mapInArrow(run, "h1 long, h2 long, rank long, gram long, seg long, at int")


class WindowIndex:
    """The log of runs; ``corpus`` (doc_id, text) has the texts of all documents added so far and to come."""

    def __init__(self, corpus: DataFrame, name: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.corpus, self.window, self.gram, self.fanout = corpus.sparkSession, corpus, window, gram, fanout
        self.log = RunLog(self.spark, name or f"window_index_{uuid.uuid4().hex}", "gram", _RUN)

    def compact(self) -> None:
        """Folds all runs into one row per segment, that of the run added first."""
        first = self.log.rows().groupBy("gram", "seg").agg(F.min(F.struct("age", "ord", "th", "a", "b")).alias("f"))
        self.log.replace(first.select("gram", "seg", "f.ord", "f.th", "f.a", "f.b"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text); returns (ord, th, s, e): its words s..e-1 that are repeats."""
        work = Workspace(self.spark)
        segs = work.write(segments(batch, self.window, self.gram), "segments")
        own = segs.groupBy("gram", "seg").agg(F.min(F.struct("ord", "th", "a", "b")).alias("f"), F.count(F.lit(1)).alias("n"))
        own = work.write(own.select("gram", "seg", "f.ord", "f.th", "f.a", "f.b", "n"), "distinct")
        known = own.select("gram", "seg", F.col("ord").alias("rank"), "ord", "th", "a", "b", "n")
        if (history := self.log.rows()) is not None:
            grams = own.select("gram").distinct()
            old = history.join(grams.hint("merge"), "gram", "left_semi").select("gram", "seg", F.lit(-1).cast("long").alias("rank"), "ord", "th", "a", "b", F.lit(1).cast("long").alias("n"))
            known = work.write(known.unionByName(old), "known")
        # whole segments: those that stand more than once, and the rank of the first
        many = known.groupBy("gram", "seg").agg(F.min("rank").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
        # parts of segments: grams that different segments have in different documents
        mixed = known.groupBy("gram").agg(F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.min(F.struct("rank", "ord")).alias("d0"), F.max(F.struct("rank", "ord")).alias("d1"))
        mixed = work.write(mixed.where("s0 <> s1 AND d0 <> d1").select("gram"), "mixed")
        # one copy of each segment; the many segments of a common gram are spread by their own hash
        copy = known.join(mixed, "gram", "left_semi").groupBy("gram", "seg").agg(F.min(F.struct("rank", "ord", "th", "a", "b")).alias("f")).select("gram", "seg", "f.*")
        wanted = work.write(copy.groupBy("ord", "th").agg(F.collect_list(F.struct("rank", "gram", "seg", "a", "b")).alias("wanted")), "wanted")
        texts = _keyed(self.corpus).join(wanted, ["ord", "th"])
        texts = texts.dropDuplicates(["ord", "th"]) if self._repeats() else texts
        windows = work.write(_windows(texts.select("text", "wanted"), self.window), "windows")
        work.drop(mixed, wanted)
        least = windows.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").drop("last")
        least = work.write(least, "least")
        # copies in documents after a segment's first are covered as a whole; the windows found are those of all copies in the first
        found = windows.join(least, ["h1", "h2"]).where("first < rank").groupBy("gram", "seg", "rank").agg(F.collect_list("at").alias("at"))
        hits = many.withColumn("at", F.lit(None).cast("array<int>")).unionByName(found.select("gram", "seg", F.col("rank").alias("first"), "at"))
        # written first: both sides of the join then come from an exchange of their own, which Spark can split where a passage is hot
        hits = work.write(hits, "hits")
        work.drop(windows, least, known)
        copies = segs.join(hits, ["gram", "seg"]).where((F.col("at").isNull() & (F.col("first") < F.col("ord"))) | (F.col("at").isNotNull() & (F.col("first") == F.col("ord"))))
        span = lambda s, last: F.struct(s.alias("s"), (last + self.window).alias("e"))
        spans = F.when(F.col("at").isNull(), F.array(span(F.col("a"), F.col("b")))).otherwise(F.transform("at", lambda k: span(F.col("a") + k, F.col("a") + k)))
        out = work.write(copies.select("ord", "th", F.explode(spans).alias("r")).select("ord", "th", "r.s", "r.e"), "covered")
        work.drop(segs, hits)
        self.log.append(own.drop("n"))
        work.drop(own)
        if len(self.log.runs) >= self.fanout:
            self.compact()
        return out

    def _repeats(self) -> bool:
        """Whether a doc_id of the corpus stands in several rows."""
        return bool(self.corpus.groupBy("doc_id").count().where("count > 1").limit(1).count())


def judge(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of docs; covered is what ``add`` returned."""
    ranges = covered.groupBy("ord", "th").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, total, removed, kept = [], [], [], []
            for ord_, text, ranges in zip(*(b.column(k) for k in range(3)), strict=True):
                words = text.as_py().encode().split()
                n = len(words)
                if ranges.is_valid:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    for r in ranges.as_py():
                        edge[r["s"]] += 1
                        edge[r["e"]] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                ids.append(None if ord_.as_py() == _LAST else ord_.as_py())
                total.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    rows = _keyed(docs).join(ranges, ["ord", "th"], "left").select("ord", "text", "ranges")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds all documents in two batches of ascending doc_id, folds their runs, and judges every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    early = F.coalesce(F.col("doc_id") <= F.lit(middle if middle is not None else 0), F.lit(False))
    index = WindowIndex(docs, fanout=2)
    covered = index.add(docs.where(early)).unionByName(index.add(docs.where(~early)))
    out = judge(docs, covered)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
