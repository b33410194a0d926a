"""Near copies of 0.8 over five-word shingles: candidates by a wide SimHash, links counted on whole texts.

Equal word sequences (A-Z lower-cased) are one text, however many documents have it. The
sketch of a text is a SimHash of ``64 * LONGS`` bits over its distinct words, indexed by
multi-index hashing: it has ``SEGMENTS`` segments of ``BITS`` bits, and each is filed
under its own value and a small Hamming ball around it. The ball flips the ``FLIPS`` bits
of the segment that were decided by the fewest votes, which are those that an edit turns
over, so that four values reach what a full ball of hundreds would. Texts of one file
whose sketches differ in ``DISTANCE`` or fewer bits over the whole width are linked; the
components of these links are blocks of candidates.

Within a block all pairs of near sketches are candidates, and every link is counted
exactly: two texts are near copies where their sets of shingles of ``WORDS`` words (the
whole sequence, if shorter) have a Jaccard similarity of ``SIMILARITY`` or more. The result
is the components of near copies. A block of up to ``BLOCK_TEXTS`` texts is searched in one
task, breadth first. Larger blocks are searched by Spark in rounds, a component at a time:
``PIVOTS`` texts that the component has gained are compared with all texts of the block that
it does not hold yet. Once a round gains little, or few texts are left, those meet all
others of the block in one join. Files of over ``FILE_TEXTS`` texts are not compared but
link all their texts, which only makes blocks larger, never loses a link.

So a pair is lost only where its sketches share no file and no third text joins their
blocks, or where they differ in more than ``DISTANCE`` bits (of the pairs at 0.8 and more in
the test tables none does); the tests measure the recall against a full comparison. Nothing
is capped, and no group of unbounded size is gathered in a task or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, mix64, text_or_empty
from .graph import components

SEED, LONGS, BITS, SEGMENTS, FLIPS, DISTANCE = 42, 7, 40, 11, 2, 56
WORDS, SIMILARITY = 5, 0.8
FILE_TEXTS, BLOCK_TEXTS, BLOCK_SHINGLES, PIVOTS, FEW, GAIN = 4_096, 20_000, 6_000_000, 64, 256, 0.1
_LAST = (1 << 63) - 1


def place(docs: DataFrame) -> tuple[Column, Column]:
    """A row's place in the order (null ids last) and a hash that tells rows of one doc_id apart."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def sketch(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of the distinct words as bytes, and the places of the least certain bits of each segment."""
    import xxhash

    distinct = list(set(words))
    votes = np.zeros(64 * LONGS, dtype=np.int64)
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, len(distinct), 8_192):
        h = np.array([hash_of(w, SEED) for w in distinct[at : at + 8_192]], dtype=np.uint64)
        lanes = np.stack([mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(LONGS)], axis=1)
        votes += np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    margin = 2 * votes - len(distinct)
    low = np.argsort(np.abs(margin[: BITS * SEGMENTS]).reshape(SEGMENTS, BITS), axis=1, kind="stable")[:, :FLIPS]
    return np.packbits(margin > 0, bitorder="little"), low.astype(np.uint8)


def sketches(docs: DataFrame) -> DataFrame:
    """(ord, th, h1, h2, bits, low) of every row: its place, 128 bits that name its word sequence, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 256):  # so that the words of few texts are in memory
                part = b.slice(at, 256)
                names, bits, low = [], [], []
                for text in part.column(2):
                    words = words_of(text.as_py())
                    names.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    votes, places = sketch(words)
                    bits.append(votes.tobytes())
                    low.append(places.tobytes())
                h = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
                columns = [part.column(0), part.column(1), *(pa.array(np.ascontiguousarray(h[:, k])) for k in (0, 1)), pa.array(bits, pa.binary()), pa.array(low, pa.binary())]
                yield pa.record_batch(columns, names=["ord", "th", "h1", "h2", "bits", "low"])

    ord_, th = place(docs)
    return docs.select(ord_.alias("ord"), th.alias("th"), text_or_empty().alias("text")).mapInArrow(run, "ord long, th long, h1 long, h2 long, bits binary, low binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def filed(texts: DataFrame) -> DataFrame:
    """(key, node): the files of every text, a ball in each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = 1 << FLIPS
        for b in batches:
            for at in range(0, b.num_rows, 2_048):
                part = b.slice(at, 2_048)
                node = part.column(0).to_numpy(zero_copy_only=False)
                bits = np.unpackbits(_matrix(part.column(1), 8 * LONGS), axis=1, bitorder="little")[:, : BITS * SEGMENTS].reshape(-1, SEGMENTS, BITS)
                low = _matrix(part.column(2), SEGMENTS * FLIPS).reshape(-1, SEGMENTS, FLIPS).astype(np.int64)
                value = bits.astype(np.int64) @ (np.int64(1) << np.arange(BITS, dtype=np.int64)) | np.arange(SEGMENTS, dtype=np.int64) << BITS
                ball = np.stack([np.bitwise_xor.reduce([np.where(m >> f & 1, np.int64(1) << low[:, :, f], 0) for f in range(FLIPS)]) for m in range(flips)], axis=2)
                keys = (value[:, :, None] ^ ball).ravel()
                yield pa.record_batch([pa.array(keys), pa.array(np.repeat(node, SEGMENTS * flips))], names=["key", "node"])

    return texts.select("node", "bits", "low").mapInArrow(run, "key long, node long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each value of the first column, which is sorted, across batches."""
    key, held = None, []
    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for s, e in zip(np.concatenate(([0], cuts)).tolist() if len(keys) else [], np.concatenate((cuts, [len(keys)])).tolist(), strict=False):
            if keys[s] != key and held:
                yield key, held
                held = []
            key = int(keys[s])
            held.append(b.slice(s, e - s))
    if held:
        yield key, held


def _near(bits: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sketches within the distance."""
    lanes, left, forest = bits.view("<u8"), np.arange(1, len(bits)), []
    queue = [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(lanes[left] ^ lanes[at]).sum(axis=1) <= DISTANCE
        if near.any():
            found = left[near].tolist()
            forest += [(at, x) for x in found]
            queue += found
            left = left[~near]
    return forest


def candidate_links(texts: DataFrame, work: Workspace, file_texts: int = FILE_TEXTS) -> DataFrame:
    """(a, b) of texts that share a file and have near sketches: a forest for each file."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = filed(texts)
    shared = work.write(files.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1"), "files")
    members = work.write(files.join(shared, "key"), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches):
            node = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts])
            bits = np.concatenate([_matrix(p.column(2), 8 * LONGS) for p in parts])
            if pairs := _near(bits):
                a, b = (node[[p[k] for p in pairs]] for k in (0, 1))
                yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    small = members.where(F.col("n") <= file_texts).select("key", "node").join(texts.select("node", "bits"), "node").select("key", "node", "bits")
    links = small.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")
    star = members.where((F.col("n") > file_texts) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
    out = work.write(links.unionAll(star).distinct(), "links")
    work.drop(shared, members)
    return out


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    import xxhash

    grams = map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64).view(np.int64))


def _shingled(rows: DataFrame) -> DataFrame:
    """(block, node, size, lanes, grams) of (block, node, bits, text); lanes are the sketch as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(words_of(t.as_py())) for t in part.column(3)]
                lanes = list(_matrix(part.column(2), 8 * LONGS).view("<i8"))
                columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(lanes, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["block", "node", "size", "lanes", "grams"])

    return rows.select("block", "node", "bits", "text").mapInArrow(run, "block long, node long, size int, lanes array<long>, grams array<long>")


def _components_of(sets: list[np.ndarray], lanes: np.ndarray) -> np.ndarray:
    """For each set the place of the first member of its component, by search breadth first."""
    size = np.array([len(s) for s in sets])
    first, left = np.arange(len(sets)), np.arange(len(sets))
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            one = sets[at]
            alike = np.flatnonzero(np.bitwise_count(lanes[left] ^ lanes[at]).sum(axis=1) <= DISTANCE)
            for k in range(0, len(alike), 2_000):
                part = left[alike[k : k + 2_000]]
                many = np.concatenate([sets[j] for j in part])
                same = one[np.minimum(np.searchsorted(one, many), len(one) - 1)] == many
                shared = np.add.reduceat(same, np.cumsum(size[part]) - size[part], dtype=np.int64)
                found = part[shared >= SIMILARITY * (len(one) + size[part] - shared)]
                first[found] = root
                queue += found.tolist()
            left = left[first[left] == left]
    return first


def _search_small(members: DataFrame) -> DataFrame:
    """(node, component) of the texts of small blocks that have a near copy."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches):
            sets: dict[int, tuple] = {}  # rows that repeat are one text
            for p in parts:
                sets |= {i: (g.values.to_numpy(), x.values.to_numpy()) for i, g, x in zip(p.column(1).to_pylist(), p.column(2), p.column(3), strict=True)}
            nodes = np.array(sorted(sets), dtype=np.int64)
            own = [sets[i] for i in nodes.tolist()]
            component = nodes[_components_of([g for g, _ in own], np.array([x for _, x in own]).view(np.uint64))]
            many = np.isin(component, component[component != nodes])
            yield pa.record_batch([pa.array(nodes[many]), pa.array(component[many])], names=["node", "component"])

    rows = members.select("block", "node", "grams", "lanes").repartition(n, "block").sortWithinPartitions("block", "node")
    return rows.mapInArrow(run, "node long, component long")


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): each text of ``left`` that has near copies in its block of ``right``, and the least of those."""
    met = _met(left, right)
    return met.groupBy("a").agg(F.min("b").alias("b"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): texts of ``left`` and their near copies in the block of ``right``."""
    other = right.select("block", F.col("node").alias("b"), F.col("size").alias("_size"), F.col("lanes").alias("_lanes"), F.col("grams").alias("_grams"))
    differ = F.aggregate(F.zip_with("lanes", "_lanes", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    alike = (F.least("size", "_size") >= SIMILARITY * F.greatest("size", "_size")) & (differ <= DISTANCE)
    shared = F.size(F.array_intersect("grams", "_grams"))
    met = left.join(other, "block").where(alike & (F.col("node") != F.col("b"))).where(shared >= SIMILARITY * (F.col("size") + F.col("_size") - shared))
    return met.select(F.col("node").alias("a"), "b")


def _search_large(members: DataFrame, work: Workspace, pivots: int = PIVOTS, few: int = FEW, gain: float = GAIN) -> DataFrame:
    """(node, component) of large blocks; each round takes one component of each block further.

    ``state``: 0 not in the component, 1 in it and not compared yet, 2 compared. A
    component without texts to compare is whole, and the next begins with the least text.
    A block of few texts in state 0, or whose last round gained less than the share
    ``gain`` of them, is finished by one join of those with each other and with state 1.
    """
    state = work.write(members.select("block", "node", F.lit(0).alias("state"), F.lit(False).alias("last")).distinct(), "state")
    found: list[DataFrame] = []
    while True:
        open_ = state.groupBy("block").agg(F.count_if(F.col("state") == 0).alias("rest"), F.max("last").alias("last")).where("rest > 0")
        open_ = work.write(open_.select("block", "rest", (F.col("last") | (F.col("rest") <= few)).alias("over")), "open")
        if not open_.limit(1).count():
            work.drop(open_, state)
            break
        live = state.where("state < 2").drop("last").join(open_, "block")
        rest = work.write(members.join(live.where("over AND state = 0").select("node"), "node", "left_semi"), "rest")
        gained = members.join(live.where("over AND state = 1").select("node"), "node", "left_semi")
        found.append(work.write(_meeting(rest, gained).unionAll(_met(rest, rest).where("a > b")), "met"))
        # else the component's new texts, or the seed of the next component, meet all that it does not hold
        order = Window.partitionBy("block").orderBy(F.col("state").desc(), "node")
        first = live.where("NOT over").withColumn("rn", F.row_number().over(order)).where((F.col("rn") == 1) | ((F.col("rn") <= pivots) & (F.col("state") == 1)))
        chosen = work.write(first.select("node"), "chosen")
        probes = work.write(members.join(chosen, "node", "left_semi"), "pivots")
        others = live.where("NOT over AND state = 0").select("node").join(chosen, "node", "left_anti")
        met = work.write(_meeting(members.join(others, "node", "left_semi"), probes), "met")
        found.append(met)
        hits = met.select(F.col("a").alias("node"), F.lit(True).alias("hit"))
        marked = state.drop("last").join(open_, "block", "left").join(chosen.withColumn("used", F.lit(True)), "node", "left").join(hits, "node", "left")
        after = F.when(F.col("over") | F.col("used"), 2).when(F.col("hit"), 1).otherwise(F.col("state"))
        new = work.write(marked.select("block", "node", after.alias("state"), "rest", F.coalesce("hit", F.lit(False)).alias("hit")), "marked")
        poor = new.groupBy("block").agg((F.count_if("hit") < gain * F.max("rest")).alias("poor"), F.count_if(F.col("state") == 1).alias("open"))
        # a component that still has texts to compare goes on, whatever the last ones gained
        ended = poor.select("block", (F.col("poor") & (F.col("open") == 0)).alias("last"))
        following = work.write(new.select("block", "node", "state").join(ended, "block"), "state")
        work.drop(open_, rest, chosen, probes, state, new)
        state = following
    links = found[0]
    for part in found[1:]:
        links = links.unionAll(part)
    out = components(links, work)
    work.drop(*found)
    return out


def near_copies(docs: DataFrame, texts: DataFrame, work: Workspace, file_texts: int = FILE_TEXTS, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(node, component) of the texts (node, ord, th, bits, low) that have near copies; docs has their words."""
    links = candidate_links(texts, work, file_texts)
    blocks = components(links, work)
    named = texts.join(blocks, "node").select(F.col("component").alias("block"), "node", "bits", F.col("ord").alias("_o"), F.col("th").alias("_t"))
    named = work.write(named, "blocks")
    ord_, th = place(docs)
    rows = docs.select(ord_.alias("ord"), th.alias("th"), text_or_empty().alias("text"))
    # merged at every size: what is joined grows with the documents
    rows = rows.join(named.hint("merge"), (rows["ord"] == named["_o"]) & (rows["th"] == named["_t"]))
    members = work.write(_shingled(rows), "shingles")
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    large = work.write(sizes.where((F.col("n") > block_texts) | (F.col("total") > BLOCK_SHINGLES)).select("block"), "large")
    if large.limit(1).count():
        crowd = work.write(members.join(large, "block", "left_semi").dropDuplicates(["node"]), "crowd")
        small = _search_small(members.join(large, "block", "left_anti"))
        out = work.write(small.unionByName(_search_large(crowd, work)), "near")
        work.drop(crowd)
    else:
        out = work.write(_search_small(members), "near")
    work.drop(links, blocks, named, members, large)
    return out


def kept_rows(docs: DataFrame, work: Workspace, file_texts: int = FILE_TEXTS, block_texts: int = BLOCK_TEXTS) -> tuple[DataFrame, bool]:
    """(_ord, _th) of one row of each group, and whether rows repeat that pair."""
    each = work.write(sketches(docs), "sketches")
    firsts = each.groupBy("h1", "h2").agg(F.min(F.struct("ord", "th")).alias("k"), F.first("bits").alias("bits"), F.first("low").alias("low"))
    texts = work.write(firsts.select(F.monotonically_increasing_id().alias("node"), "k.ord", "k.th", "bits", "low"), "texts")
    repeated = bool(each.groupBy("ord", "th").count().where("count > 1").limit(1).count())
    work.drop(each)
    groups = near_copies(docs, texts, work, file_texts, block_texts)
    placed = texts.join(groups, "node").select("node", "component", "ord", "th")
    stay = placed.groupBy("component").agg(F.min(F.struct("ord", "th", "node")).alias("k")).select(F.col("k.node").alias("stay"))
    gone = work.write(placed.join(stay, placed["node"] == F.col("stay"), "left_anti").select(F.col("node").alias("gone")), "gone")
    kept = work.write(texts.join(gone, texts["node"] == gone["gone"], "left_anti").select(F.col("ord").alias("_ord"), F.col("th").alias("_th")), "kept")
    work.drop(texts, groups, gone)
    return kept, repeated
