"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z only) and cut into words and shingles of ``SHINGLE`` words;
a bit of its fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes.
Fingerprints are linked at ``DISTANCE`` or fewer differing bits.

Multi-index hashing: a fingerprint has ``SEGMENTS`` segments of 32 bits. Two that differ
in at most 4 bits differ in at most 2 within one segment, so the Hamming balls of radius
1 around their values in that segment meet. Each distinct fingerprint is filed under the
33 values of each ball; the fingerprints of one file are compared in full, and of the
links found there a spanning forest is passed on: the same components with no more
links than members. Equal fingerprints are one entry, however many documents have them.

Files of over ``FILE_LIMIT`` fingerprints are not compared in one task. Their members
are filed anew under all 2,081 values within distance 2 of the whole fingerprint, where
members of one file are within distance 4 of each other by the triangle inequality, and
all linked ones meet: an exact way, linear in the members, for any concentration.

``deduplicate`` keeps one document of each group of near copies, by the same method with a
wider fingerprint and an exact count of what it finds: see ``near_copies``.

Defined cases: a null text is an empty text; a text without words has fingerprint 0 and
is linked like any other; a text of fewer words than a shingle is one shingle; a null
doc_id keeps its row and fingerprint, takes part in links, and a component of null ids
alone has a null id; rows that repeat a doc_id are separate documents; an empty table
gives an empty result; other columns pass through ``deduplicate`` untouched. There, null
ids come last, rows of one doc_id and different texts are separate documents, and rows
that repeat both are copies of which one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, table, text_or_empty
from .graph import components
from .near_copies import kept_rows, place

SHINGLE, SEED, DISTANCE, FILE_LIMIT = 4, 42, 4, 4_096
_ONE = np.uint64(1)
_BITS = _ONE << np.arange(64, dtype=np.uint64)
#: Flips within distance 2 of a fingerprint.
_PAIRS = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))], dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text, unsigned; long texts are counted in pieces."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, n, 8_192):
        part = words[at : min(at + 8_192, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(part) >= shingle else [b" ".join(part)]
        hashes = np.array([hash_of(g, SEED) for g in grams], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[counts * 2 > n].sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _filed(fps: DataFrame) -> DataFrame:
    """(file, value, fp): the radius-1 ball of each 32-bit segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate((np.zeros(1, np.uint64), _BITS[:32]))
        for b in batches:
            for at in range(0, b.num_rows, 4_096):
                fp = b.column(0).slice(at, 4_096).to_numpy(zero_copy_only=False).view(np.uint64)
                for k in (0, 1):
                    value = ((fp >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF))[:, None] ^ flips
                    key = (value | (np.uint64(k) << np.uint64(32))).ravel()
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, 33).view(np.int64))], names=["file", "fp"])

    return fps.mapInArrow(run, "file long, fp long")


def _links_within(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints of one file."""
    if len(fp) == 2:
        return [(0, 1)] if int(fp[0] ^ fp[1]).bit_count() <= DISTANCE else []
    left, forest = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= DISTANCE
            if near.any():
                found = left[near]
                forest += [(at, x) for x in found]
                queue += found.tolist()
                left = left[~near]
    return forest


def _compare(limit: int):
    """Reads (file, fp) sorted by file; gives links (a, b), and (fp, null) for members of large files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size, spilled = None, [], 0, False

        def close() -> list[tuple[int, int | None]]:
            if size < 2 or spilled:
                return []
            fp = np.unique(np.concatenate(parts))
            signed = fp.view(np.int64)
            return [(int(signed[a]), int(signed[b])) for a, b in _links_within(fp)]

        for b in batches:
            files, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            out: list[tuple[int, int | None]] = []
            cuts = np.flatnonzero(np.diff(files)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(files)]))
            # files of one row that neither open nor close the batch have nothing to compare
            wanted = ends - starts > 1
            if len(wanted):
                wanted[[0, -1]] = True
            for s, e in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                if files[s] != key:
                    out += close()
                    key, parts, size, spilled = files[s], [], 0, False
                size += e - s
                parts.append(fps[s:e])
                if size > limit:
                    spilled = True
                    out += [(int(x), None) for part in parts for x in part.view(np.int64)]
                    parts = []
            if out:
                yield _pairs(out)
        if last := close():
            yield _pairs(last)

    return run


def _pairs(rows: list[tuple[int, int | None]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"])


def _centres(fps: DataFrame) -> DataFrame:
    """(centre, fp) for every value within distance 2 of fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                fp = b.column(0).slice(at, 64).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.record_batch(
                    [pa.array((fp[:, None] ^ _PAIRS).ravel().view(np.int64)), pa.array(np.repeat(fp, len(_PAIRS)).view(np.int64))],
                    names=["centre", "fp"],
                )

    return fps.mapInArrow(run, "centre long, fp long")


def fingerprint_links(fps: DataFrame, work: Workspace, file_limit: int = FILE_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) whose components are those of all links."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = work.write(_filed(fps).repartition(n, "file").sortWithinPartitions("file").mapInArrow(_compare(file_limit), "a long, b long"), "links")
    links = found.where("b IS NOT NULL")
    crowded = work.write(found.where("b IS NULL").select(F.col("a").alias("fp")).distinct(), "crowded")
    if not crowded.limit(1).count():
        work.drop(crowded)
        return links
    # the side of least fingerprints is written before it is joined, so that Spark can split a centre that many share
    filed = work.write(_centres(crowded), "centres")
    least = work.write(filed.groupBy("centre").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("centre", "a"), "least")
    starred = work.write(filed.join(least, "centre").where("a <> fp").select("a", F.col("fp").alias("b")).distinct(), "starred")
    work.drop(least, crowded, filed)
    return links.unionAll(starred)


def cluster(docs: DataFrame, shingle: int = SHINGLE, file_limit: int = FILE_LIMIT) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    work = Workspace(docs.sparkSession)
    each = work.write(with_fingerprints(docs, shingle), "fingerprints")
    distinct = work.write(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(fingerprint_links(distinct.select("fp"), work, file_limit), work)
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = work.write(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = work.write(named.join(smallest, "component").select("fp", "component_id"), "ids")
    work.keep(each, ids)
    return each.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, **limits: int) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; all columns as they were."""
    work = Workspace(docs.sparkSession)
    kept, repeated = kept_rows(docs, work, **limits)
    work.keep(kept)
    ord_, th = place(docs)
    if not repeated:
        return docs.join(kept.hint("merge"), (ord_ == kept["_ord"]) & (th == kept["_th"]), "left_semi")
    a, b = fresh(docs.columns, "ord", "th")
    rows = docs.withColumns({a: ord_, b: th}).dropDuplicates([a, b])
    return rows.join(kept.hint("merge"), (rows[a] == kept["_ord"]) & (rows[b] == kept["_th"]), "left_semi").select(*docs.columns)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
