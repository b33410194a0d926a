"""Token ids in binary shards with a shared compression dictionary and an offset index.

Every document is encoded on its own, ends with ``end_id`` and becomes one zstandard
frame over its ids (little-endian, 2 bytes each where the vocabulary allows, else 4).
Frames use one dictionary trained on serialised id arrays, so that also short
documents compress well and can be read alone.

Layout under ``path`` (all written by Spark's committers, so lost tasks leave nothing):

``dictionary/``  dict_hash, id_width, dictionary   one row
``shards/``      part, shard, dict_hash, doc_ids, n_tokens, before, offsets, payload
                 frames in ascending doc_id order; frame i is payload[offsets[i]:offsets[i + 1]]
``parts/``       part, base                        ids of all documents in earlier parts
``index/``       doc_id, start, n_tokens, part, shard, offset, length, dict_hash

Defined cases: a null or empty text is a document of the end id alone; a null doc_id
sorts first; rows that repeat a doc_id are kept, side by side, ordered by their ids;
an empty table gives empty shards; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import string
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LANE_MASKS, WordBuffer, remove, scratch, table, text_or_empty

#: Bounds of the dictionary: sampled documents, code points of each, bytes trained.
DICT_DOCS, DICT_CHARS, DICT_BYTES = 400, 8_000, 32_768
#: When the encoder's memo holds more words, those met once are dropped, and others beyond half of it.
MEMO_WORDS = 400_000
#: Texts are encoded together until they have this many bytes; arrays over their words take some forty times that.
ENCODED_BYTES = 2_000_000
#: A shard row is closed once its payload reaches this size.
SHARD_BYTES = 1 << 20

_FRAMES = "doc_id long, n_tokens long, frame binary"
_SHARDS = "part int, shard int, first long, dict_hash string, doc_ids array<long>, n_tokens array<long>, before array<long>, offsets array<long>, payload binary"


#: White space beyond the six ASCII characters; texts with any go through the tokenizer as they stand.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")


def _is_odd(text: str) -> bool:
    if text.isascii():  # most are, and single characters are found sooner than a class
        return "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return bool(_OTHER_SPACE.search(text))


class BatchEncoder:
    """Encodes batches of whole texts with a byte-level tokenizer, distinct words once.

    The tokenizer's splitting ends a token before every single space or newline that
    stands between two other characters, so a text can be cut there without changing
    one id. Words that a bounded memo lacks are encoded together, those that differ in
    the punctuation at their end once, and all are gathered by position; texts with any other white space, or special-token text, are encoded whole.
    Words of a batch are grouped by a hash, but no id rests on it: every word is compared
    with the first of its group byte by byte, and the memo knows words by their bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65_536 else np.dtype("<u4")
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.spaced[[i for piece, i in vocab.items() if piece.startswith("\u0120")]] = True
        self.newline = vocab["\u010a"]
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        opens = lambda c: all(self.tokenizer.pre_tokenizer.pre_tokenize_str(a + c)[0][1] == (0, 1) for a in "a0")
        #: Marks that begin a token behind a letter or digit; an apostrophe may begin one with letters.
        self.tails = "".join(c for c in string.punctuation if c != "'" and c not in added and opens(c)).encode()
        self._empty()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, behind a space or bare, and the number of each word's ids."""
        flat, sizes = [], []
        for i in range(0, len(words), 2_000):
            part = words[i : i + 2_000]
            (ids,) = self._ids([(b" " + b" ".join(part) if spaced else b"\n".join(part)).decode()])
            cut = np.flatnonzero(self.spaced[ids]) if spaced else np.concatenate(([-1], np.flatnonzero(ids == self.newline)))
            assert len(cut) == len(part), "the tokenizer joins words"
            sizes.append(np.diff(np.append(cut, len(ids))) - (not spaced))
            flat.append(ids if spaced else ids[ids != self.newline])
        return np.concatenate([*flat, np.empty(0, self.dtype)]), np.concatenate([*sizes, np.empty(0, np.int64)])

    def _learn(self, words: list[bytes], spaced: bool) -> np.ndarray:
        """The memo's places of distinct words behind a space, or bare; words that it lacks are encoded."""
        memo = self.memo[spaced]
        place = np.fromiter(map(memo.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            own = [words[k] for k in new.tolist()]
            stems = [self._stem(w) for w in own]
            plain = [s for s in dict.fromkeys(stems) if s not in memo]
            self._enter(memo, plain, *self._words(plain, spaced))
            cut = [(w, s, w[len(s) :]) for w, s in zip(own, stems, strict=True) if len(s) < len(w)]
            if cut:
                tails = list(dict.fromkeys(t for _, _, t in cut))
                tail_of = dict(zip(tails, self._learn(tails, False).tolist(), strict=True))
                parts = np.array([k for _, s, t in cut for k in (memo[s], tail_of[t])])
                self.uses[parts] += 1
                size = self.size[parts]
                source = np.arange(size.sum()) + np.repeat(self.begin[parts] - np.cumsum(size) + size, size)
                self._enter(memo, [w for w, _, _ in cut], self.flat[source], size.reshape(-1, 2).sum(axis=1))
            place[new] = [memo[w] for w in own]
        self.uses[place] += 1
        return place

    def _stem(self, word: bytes) -> bytes:
        """The word without the punctuation at its end, which has tokens of its own; the whole word where that may not be."""
        stem = word.rstrip(self.tails)
        return stem if stem[-1:].isalnum() else word

    def _enter(self, memo: dict[bytes, int], words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        memo.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, ids))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int32)))

    def _trim(self) -> None:
        """Drops the words that one group of texts alone had, and the least used ones beyond half of the memo."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > MEMO_WORDS // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: MEMO_WORDS // 2]])
        places = np.full(len(self.size), -1)
        places[keep] = np.arange(len(keep))
        self.memo = tuple({w: k for w, k in zip(m, places[np.fromiter(m.values(), np.int64, len(m))].tolist(), strict=True) if k >= 0} for m in self.memo)
        size = self.size[keep]
        begin = 1 + np.cumsum(size) - size
        ids = self.flat[np.arange(1, 1 + size.sum()) + np.repeat(self.begin[keep] - begin, size)]
        self.begin, self.size, self.flat, self.uses = begin, size, np.concatenate((self.flat[:1], ids)), self.uses[keep] // 2

    def _empty(self) -> None:
        self.memo: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        self.begin, self.size, self.uses = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.array([self.newline], dtype=self.dtype)  # a newline's id has place 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        words = WordBuffer([t.encode() for t in texts])
        first, data = words.first, words.data
        lead = data[np.maximum(words.starts - 1, 0)]
        gap = words.starts - np.concatenate(([-1], words.ends[:-1]))
        opens = np.zeros(len(words.starts), dtype=bool)
        opens[first[:-1][first[:-1] < first[1:]]] = True
        odd = np.concatenate(([0], np.cumsum(~opens & ((gap != 1) | ((lead != 32) & (lead != 10))))))
        whole = [
            bool(odd[b] - odd[a]) or a == b or words.starts[a] != words.bases[i] or words.ends[b - 1] != words.bases[i + 1] - 1 or _is_odd(texts[i])
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        ]
        for i, ids in zip(np.flatnonzero(whole), self._ids([t for t, w in zip(texts, whole, strict=True) if w]), strict=True):
            out[i] = ids
        bare = opens | (lead == 10)
        hashes = words.word_hashes() ^ bare.astype(np.uint64)
        keep = ~np.repeat(np.array(whole, dtype=bool), np.diff(first))
        at = np.flatnonzero(keep)
        # any word of a hash may stand for it, so an unstable sort will do, which is much faster than numpy's unique
        own = hashes[keep]
        order = np.argsort(own)
        ranked = own[order]
        opening = np.ones(len(own), dtype=bool)
        opening[1:] = ranked[1:] != ranked[:-1]
        inverse = np.empty(len(own), dtype=np.int64)
        inverse[order] = np.cumsum(opening) - 1
        raw, where = data.tobytes(), at[order[opening]]
        for i in np.unique(np.searchsorted(first, at[~self._same(words, raw, at, where, inverse, bare)], side="right") - 1).tolist():
            out[i] = self._ids([texts[i]])[0]  # it has another word of the same hash
        if len(self.size) > MEMO_WORDS:
            self._trim()
        place = np.empty(len(where), dtype=np.int64)
        for spaced in (True, False):
            own = np.flatnonzero(bare[where] != spaced)
            place[own] = self._learn([raw[s:e] for s, e in zip(words.starts[where[own]].tolist(), words.ends[where[own]].tolist(), strict=True)], spaced)
        begin, size, flat = self.begin[place], self.size[place], self.flat
        broken = (bare & ~opens)[keep]  # a newline's id goes before the word's
        total = size[inverse] + broken
        ends = np.cumsum(total)
        source = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - total - begin[inverse] + broken, total)
        source[(ends - total)[broken]] = 0
        ids = flat[source]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(keep)))[first]]
        for i in np.flatnonzero(~np.array(whole, dtype=bool)):
            if out[i] is None:
                out[i] = ids[bounds[i] : bounds[i + 1]]
        return out

    @staticmethod
    def _same(words: WordBuffer, raw: bytes, at: np.ndarray, where: np.ndarray, inverse: np.ndarray, bare: np.ndarray) -> np.ndarray:
        """Whether words ``at`` have the bytes of those that stand for them, ``where[inverse]``.

        The first and last eight bytes are compared at once, those between word by word.
        """
        start, end = words.starts[at], words.ends[at]
        size, short = end - start, np.minimum(end - start, 8)
        size_of, lane_of = words.ends[where] - words.starts[where], words.lane(words.starts[where])
        same = (size == size_of[inverse]) & (bare[at] == bare[where][inverse])
        same &= ((words.lane(start) ^ lane_of[inverse]) & LANE_MASKS[short]) == 0
        more = np.flatnonzero(same & (size > 8))
        like = where[inverse[more]]
        same[more] = words.lane(end[more] - 8) == words.lane(words.ends[like] - 8)
        for k in more[same[more] & (size[more] > 16)].tolist():
            j = where[inverse[k]]
            same[k] = raw[start[k] : end[k]] == raw[words.starts[j] : words.ends[j]]
        return same


def _encoder(path: str) -> BatchEncoder:
    """The encoder of this worker process, with the words it has met in earlier tasks.

    Worker functions travel by value, so a global of this module would be new in each task.
    """
    kept = sys.modules.setdefault("_oncelog_encoders", ModuleType("_oncelog_encoders")).__dict__
    if path not in kept:
        kept[path] = BatchEncoder(path)
    return kept[path]


def _groups(rows: Iterator[tuple], size, most: int) -> Iterator[list]:
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += size(row)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def _text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """(doc_id, text, bytes) of documents to encode together; few of a batch's texts are strings at once."""
    slices = (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500))
    rows = (r for b in slices for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.binary_length(b.column(1)).to_pylist(), strict=True))
    return _groups(rows, lambda r: r[2], ENCODED_BYTES)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, dictionary: bytes | None) -> DataFrame:
    """(doc_id, n_tokens, frame) of every document; the frame holds its ids and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(tokenizer_path), _compressor(dictionary)
        for group in _text_groups(batches):
            ids = [np.append(x, encoder.dtype.type(end_id)) for x in encoder.encode([t for _, t, _ in group])]
            yield pa.record_batch(
                [pa.array([d for d, _, _ in group], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([packer.compress(x.tobytes()) for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "frame"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _FRAMES)


def _compressor(dictionary: bytes | None):
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes | None):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary from the serialised ids of about DICT_DOCS documents, chosen by a hash of doc_id.

    The sample is a bounded parameter of compression alone: no id depends on it.
    """
    import zstandard

    rows = docs.where(F.col("doc_id").isNotNull())
    share = min(1.0, DICT_DOCS / max(1, rows.select("doc_id").count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = rows.where(chosen).select(F.substring(text_or_empty(), 1, DICT_CHARS).alias("text")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(t for b in batches for t in b.column("text").to_pylist())
        if not texts:
            return
        arrays = [x.tobytes() for x in BatchEncoder(tokenizer_path).encode(texts)]
        try:
            out = zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
        except zstandard.ZstdError:  # too few or too uniform samples to train on
            out = b"".join(arrays)[:DICT_BYTES]
        yield pa.record_batch([pa.array([out], pa.binary())], names=["dictionary"])

    trained = sample.mapInArrow(run, "dictionary binary").collect()
    return bytes(trained[0][0]) if trained else b""


@dataclass(frozen=True)
class TokenStore:
    """A written corpus of token ids."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _dictionary(self) -> tuple[str, int, bytes]:
        row = self._read("dictionary").first()
        return row.dict_hash, row.id_width, bytes(row.dictionary)

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
        name, width, dictionary = self._dictionary()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = _decompressor(dictionary)
            for b in batches:
                for start, known, ids, sizes, offsets, payload in zip(*(b.column(k) for k in range(6)), strict=True):
                    if known.as_py() != name:
                        raise ValueError(f"shard of dictionary {known}, not {name}")
                    data, cuts, sizes = payload.as_py(), offsets.as_py(), np.array(sizes.as_py(), dtype=np.int64)
                    sums = []
                    for i, n in enumerate(sizes):
                        raw = np.frombuffer(unpack.decompress(data[cuts[i] : cuts[i + 1]]), dtype=f"<u{width}")
                        if len(raw) != n:
                            raise ValueError("a frame does not hold the ids that the index names")
                        sums.append(zlib.crc32(raw.astype("<u4").tobytes()))
                    yield pa.record_batch(
                        [pa.array(ids.as_py(), pa.int64()), pa.array(start.as_py() + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

        return self._placed().select("start", "dict_hash", "doc_ids", "n_tokens", "offsets", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def _placed(self) -> DataFrame:
        """Shards with the number of ids before them; ``parts`` has one row for each range of doc_id."""
        placed = self._read("shards").join(F.broadcast(self._read("parts")), "part")
        return placed.withColumn("start", F.col("base") + F.col("first"))

    def get(self, doc_id: int) -> list[list[int]]:
        """The ids of the documents of one doc_id: reads the index, then only their shards."""
        _, width, dictionary = self._dictionary()
        out = []
        for row in self._read("index").where(F.col("doc_id") == doc_id).orderBy("start").toLocalIterator():
            payload = self._read("shards").where((F.col("part") == row.part) & (F.col("shard") == row.shard)).select(F.substring("payload", row.offset + 1, row.length)).first()[0]
            out.append(np.frombuffer(_decompressor(dictionary).decompress(bytes(payload)), dtype=f"<u{width}").tolist())
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, partitions: int | None = None) -> TokenStore:
    """Encodes docs (doc_id, text) and writes the store under path.

    Frames are computed once into a scratch table and then dealt out by ranges of
    doc_id, so that only compressed ids are shuffled; the ids before a range come
    from one total for each range.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dictionary = train_dictionary(docs, tokenizer_path)
    name = f"{zlib.crc32(dictionary):08x}{len(dictionary):x}"
    width = BatchEncoder(tokenizer_path).dtype.itemsize
    spark.createDataFrame([(name, width, bytearray(dictionary))], "dict_hash string, id_width int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = scratch(spark, "frames")
    encoded(docs, tokenizer_path, end_id, dictionary).write.parquet(frames)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        first = 0
        for shard, group in enumerate(_groups(rows, lambda r: len(r[2]), SHARD_BYTES)):
            offsets = np.concatenate(([0], np.cumsum([len(f) for _, _, f in group]))).tolist()
            before = np.concatenate(([0], np.cumsum([t for _, t, _ in group])[:-1])).tolist()
            yield pa.record_batch(
                [
                    pa.array([part], pa.int32()),
                    pa.array([shard], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([name]),
                    pa.array([[d for d, _, _ in group]], pa.list_(pa.int64())),
                    pa.array([[t for _, t, _ in group]], pa.list_(pa.int64())),
                    pa.array([before], pa.list_(pa.int64())),
                    pa.array([offsets], pa.list_(pa.int64())),
                    pa.array([b"".join(f for _, _, f in group)], pa.binary()),
                ],
                names=["part", "shard", "first", "dict_hash", "doc_ids", "n_tokens", "before", "offsets", "payload"],
            )
            first += sum(t for _, t, _ in group)

    ranged = spark.read.schema(_FRAMES).parquet(frames).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")
    ranged.mapInArrow(shards, _SHARDS).write.option("compression", "none").parquet(f"{path}/shards")
    remove(spark, frames)
    written = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    own = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = written.select("part", own.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row for each range
    totals.select("part", base.alias("base")).write.parquet(f"{path}/parts")
    store = TokenStore(spark, path)
    placed = store._placed().select("part", "shard", "start", "dict_hash", "n_tokens", "before", "offsets", F.posexplode("doc_ids").alias("i", "doc_id"))
    item = lambda name, k=1: F.element_at(name, F.col("i") + k)
    placed.select(
        "doc_id", (F.col("start") + item("before")).alias("start"), item("n_tokens").alias("n_tokens"), "part", "shard",
        item("offsets").alias("offset"), (item("offsets", 2) - item("offsets")).alias("length"), "dict_hash",
    ).write.parquet(f"{path}/index")
    return store


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as token ids and returns what the files hold."""
    return write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), default_tokenizer()).documents()
