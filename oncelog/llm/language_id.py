"""Language identification by segmentation-marginalised unigram models.

The pieces are those of a fixed public vocabulary; each language has a probability for
each piece. A word's likelihood sums the probabilities of all its segmentations into
pieces (a forward algorithm over its characters), a text's log-likelihood sums those of
its words, and the score is the posterior of the best language under equal priors.

Training: expected piece counts over all segmentations (forward and backward sums) are
gathered by Spark over the distinct words of a sample of labelled rows and re-estimated
``ROUNDS`` times. The sample is chosen by a hash of doc_id so that about ``TRAIN_ROWS``
rows are read, fewer where there are fewer; the model has one number for each piece and
language, so its size does not depend on the corpus.

Sums are scaled wherever they become small, so that no word is too long for them.

Defined cases: a null text, or one without letters (``\\p{L}``), is ``und`` with score 0; texts
are scored whole; a text without a learned language (no labelled rows at all) is ``und``;
ties go to the language that sorts first; a null doc_id is hashed as an empty string;
rows with a null text or lang are never learned from; other columns pass through
``keep_identified`` untouched, whatever their names. It rejects ``und`` and texts for which
no language has ``MIN_SCORE`` of the posterior, that is, where none is likelier than all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

#: About how many labelled rows the model is fitted on, and rounds of re-estimation.
TRAIN_ROWS, ROUNDS, SMOOTHING, MIN_SCORE = 12_000, 2, 0.1, 0.5
FOLDS, UNKNOWN = 5, "und"
_MAX_PIECE, _MEMO, _OTHER = 12, 200_000, 1e-9
#: Sums below _SMALL are multiplied by _UP.
_SMALL, _UP = 1e-100, 1e100
_LETTERS = regex.compile(r"\p{L}+")
_START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(vocabulary: str) -> list[str]:
    """The vocabulary's pieces that occur in lower-case words, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    spelled = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in dict.fromkeys(spelled) if len(p) <= _MAX_PIECE and p.removeprefix(_START).isalpha() and p == p.lower()]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` labelled rows outside the held-out fold, by a hash of doc_id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = min(1.0, rows / max(1, labelled.select("lang").count()))
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("sample")), F.lit(1 << 30))
    return labelled.where(place < int(share * (1 << 30))).select("lang", "text")


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of the lower-case words of labelled texts."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    return labelled.select("lang", words.alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def _segment_counts(word: str, p: dict[str, float]) -> Iterator[tuple[str, float]]:
    """The expected number of times that each piece is used in a word with its start mark.

    ``up[i]`` counts how often the sums from the left were scaled by place i, ``down[i]`` those from the right.
    """
    n = len(word)
    forward, arcs, up = [1.0] + [0.0] * n, [], [0] * (n + 1)
    for i in range(n):
        if forward[i] < _SMALL:
            for j in range(i, min(n, i + _MAX_PIECE) + 1):
                forward[j] *= _UP
            up[i] += 1
        up[i + 1] = up[i]
        for j in range(i + 1, min(n, i + _MAX_PIECE) + 1):
            q = p.get(word[i:j])
            if q is None and j == i + 1:
                q = _OTHER
            if q:
                forward[j] += forward[i] * q
                arcs.append((i, j, q))
    backward, down = [0.0] * n + [1.0], [0] * (n + 1)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, q in arcs:
        into[j].append((i, q))
    for j in range(n, 0, -1):
        if backward[j] < _SMALL:
            for i in range(max(0, j - _MAX_PIECE), j + 1):
                backward[i] *= _UP
            down[j] += 1
        down[j - 1] = down[j]
        for i, q in into[j]:
            backward[i] += q * backward[j]
    for i, j, q in arcs:
        yield word[i:j], forward[i] * q * backward[j] / forward[n] * _UP ** (up[n] - up[i] - down[j])


def train(docs: DataFrame, vocabulary: str, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> dict[str, dict[str, float]]:
    """The probability of each piece for each language; the model alone comes to the driver."""
    known = pieces(vocabulary)
    counts = materialize(word_counts(sample(docs, rows)), "words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    prior = {p: math.exp(-len(p)) for p in known}
    model = {lang: _normal(prior, known) for lang in langs}
    for _ in range(rounds if langs else 0):
        current = model

        def expect(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[str, str], float] = {}
            for b in batches:
                for lang, word, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    p = current[lang]
                    for piece, x in _segment_counts(_START + word, p):
                        if piece in p:
                            total[lang, piece] = total.get((lang, piece), 0.0) + n * x
            keys = sorted(total)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.float64())], names=["lang", "piece", "n"])

        found: dict[str, dict[str, float]] = {lang: {} for lang in langs}
        for lang, piece, n in counts.mapInArrow(expect, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n")).collect():
            found[lang][piece] = round(n, 6)  # sums of doubles arrive in any order
        model = {lang: _normal(found[lang], known) for lang in langs}
    return model


def _normal(counts: dict[str, float], known: list[str]) -> dict[str, float]:
    total = sum(counts.get(p, 0.0) + SMOOTHING for p in known)
    return {p: (counts.get(p, 0.0) + SMOOTHING) / total for p in known}


class Scorer:
    """Log-likelihoods under all languages at once, with a bounded memo of words."""

    def __init__(self, model: dict[str, dict[str, float]]):
        self.langs = sorted(model)
        known = sorted({p for m in model.values() for p in m})
        self.ids = {p: i + 2 for i, p in enumerate(known)}
        # row 0: not a piece; row 1: a single character outside the vocabulary
        self.rows = np.zeros((len(known) + 2, len(self.langs)))
        self.rows[1] = _OTHER
        for k, lang in enumerate(self.langs):
            self.rows[2:, k] = [model[lang][p] for p in known]
        self.memo: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log of the summed probability of all segmentations of words of one length."""
        n = len(words[0])
        alpha = np.zeros((n + 1, len(words), len(self.langs)))
        alpha[0] = 1.0
        scaled = np.zeros(alpha.shape[1:])
        find = self.ids.get
        for i in range(n):
            small = alpha[i] < _SMALL
            if small.any():
                alpha[i : i + _MAX_PIECE + 1] *= np.where(small, _UP, 1.0)
                scaled += small
            for j in range(i + 1, min(n, i + _MAX_PIECE) + 1):
                other = 1 if j == i + 1 else 0
                ids = np.fromiter((find(w[i:j], other) for w in words), dtype=np.int64, count=len(words))
                if ids.any():
                    alpha[j] += alpha[i] * self.rows[ids]
        return np.log(alpha[n]) - scaled * math.log(_UP)

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[tuple[int, str]]] = {}
        for at, w in enumerate(words):
            by_length.setdefault(len(w), []).append((at, _START + w))
        total = np.zeros((len(words), len(self.langs)))
        for length, group in by_length.items():
            step = max(1, min(4_096, 500_000 // length))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                total[[at for at, _ in part]] = self.forward([w for _, w in part])
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words)), strict=True))
        self.table = np.concatenate((self.table, total))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        new = [w for w in dict.fromkeys(w for words in split for w in words) if w not in self.memo]
        if len(self.memo) + len(new) > _MEMO:
            self.memo, self.table = {}, self.table[:0]
            new = list(dict.fromkeys(w for words in split for w in words))
        if new:
            self.learn(new)
        langs, scores = [], []
        for words in split:
            if not words:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            langs.append(self.langs[best])
            scores.append(float(odds[best] / odds.sum()))
        return langs, scores


def predict(docs: DataFrame, model: dict[str, dict[str, float]], name: str = "_scored") -> DataFrame:
    """docs with a column ``name`` (lang_pred, score); only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in parts:
            langs, scores = [], []
            for at in range(0, len(texts), 512):
                for got, x in zip((langs, scores), scorer.score(texts.iloc[at : at + 512].tolist()), strict=True):
                    got += x
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(name, scored("text"))


def keep_identified(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of docs whose language is told with at least ``MIN_SCORE``."""
    model = train(docs, vocabulary or default_vocabulary())
    columns, (name,) = docs.columns, fresh(docs.columns, "scored")
    told = F.col(name)
    return predict(docs, model, name).where((told["lang_pred"] != UNKNOWN) & (told["score"] >= MIN_SCORE)).select(*columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, train(docs, default_vocabulary()))
    return out.select("doc_id", held_out().alias("held_out"), "_scored.lang_pred", "_scored.score")
