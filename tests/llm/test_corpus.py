"""Token output, mixing, decontamination, license scans and the pipeline."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oncelog.llm import decontamination, license_scan, source_mix, token_output
from oncelog.llm.common import materialize, scratch

TOKENIZER = token_output.default_tokenizer()
ODD = ["", " ", "a", "a b", "a  b", "a \n b", "a\n\nb", "it's a dog's\nlife. x, y", "  lead", "trail ", "x\t y", "a b\n", "\n a", "é è  z", "x\xa0 y z", "<|endoftext|> a", "'s 's\n's", "日本 語\nテ 😀 ok", "\x1c a\x1cb"]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_batch_encoder_is_exact():
    r = random.Random(2)
    texts = [*ODD, *("".join(r.choice("ab .,'\n\t1é") for _ in range(r.randint(0, 60))) for _ in range(3_000)), "word " * 30_000]
    got = token_output.BatchEncoder(TOKENIZER).encode(texts)
    assert [x.tolist() for x in got] == plain_ids(texts)


def test_known_words_are_encoded_once(monkeypatch):
    """Words keep their ids when the memo is trimmed, and punctuation at their end does not make them new."""
    import string

    monkeypatch.setattr(token_output, "MEMO_WORDS", 300)
    r = random.Random(3)
    often = ["".join(r.choice("abcdé0") for _ in range(r.randint(1, 9))) for _ in range(60)]
    encoder, asked = token_output.BatchEncoder(TOKENIZER), []
    words = encoder._words
    monkeypatch.setattr(encoder, "_words", lambda own, spaced: asked.extend((w, spaced) for w in own) or words(own, spaced))
    for k in range(40):
        rare = [f"r{k}x{n}" for n in range(40)]
        texts = [" ".join(["start", *rare, *often]), " ".join(w + r.choice(["", ".", "'", "'s", "###", "!?", "\u2026.", "'.", ">"]) for w in often), "\n".join("".join(r.choice("a1é'\u2026\u0301" + string.punctuation) for _ in range(r.randint(1, 6))) for _ in range(20))]
        assert [x.tolist() for x in encoder.encode(texts)] == plain_ids(texts)
        assert len(encoder.size) <= 300 + 400
    assert max(asked.count((w.encode(), True)) for w in often) <= 3
    assert not any((w + "###").encode() in {x for x, _ in asked} for w in often if w[-1].isascii())


@pytest.mark.parametrize("bits", [64, 2])
def test_no_id_rests_on_a_hash(monkeypatch, bits):
    """Words that polynomial hashes confuse, and hashes cut to two bits: every word meets many others of its hash."""
    from oncelog.llm.common import WordBuffer

    whole = WordBuffer.word_hashes
    monkeypatch.setattr(WordBuffer, "word_hashes", lambda self: whole(self) & np.uint64((1 << bits) - 1))
    morse = lambda n, a, b: "".join(b if bin(k).count("1") % 2 else a for k in range(n))
    r = random.Random(9)
    texts = [f"x {morse(n, *ab)} y\n{morse(n, *ab)}" for n in (1_024, 2_048, 4_096) for ab in ("ab", "ba")] + ["a " + "b" * k + " " + "b" * (k - 1) + "c" for k in range(1, 40)]
    texts += [" ".join(r.choice(["aa", "bb", "a" * 9, "a" * 17 + "b", "a" * 18, "a" * 8 + "c" + "a" * 9]) for _ in range(30)) for _ in range(50)]
    encoder = token_output.BatchEncoder(TOKENIZER)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == plain_ids(texts)


def test_token_store_round_trip(spark):
    rows = [(i * 3 % 40, t, 7) for i, t in enumerate(ODD)] + [(None, "null id", 7), (5, None, 7), (5, "again again", 7), (99, "long text " * 40_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    store = token_output.write_tokens(docs, scratch(spark, "test"), TOKENIZER, partitions=3)
    got = store.documents().orderBy("start").collect()
    ids = {(i, k): [*x, 2] for k, ((i, _, _), x) in enumerate(zip(rows, plain_ids([t or "" for _, t, _ in rows]), strict=True))}
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), crc(x)) for (i, _), x in ids.items())
    assert store.get(99) == [x for (i, _), x in ids.items() if i == 99]
    assert sorted(store.get(5)) == sorted(x for (i, _), x in ids.items() if i == 5) and store.get(12345) == []


def test_token_store_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.write_tokens(docs, scratch(spark, "test"), TOKENIZER).documents().count() == 0


def mixed(spark, rows, labels=()):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size long, n_chars long")
    sized = materialize(docs.select("doc_id", "source", source_mix.size_of(F.col("text")).alias("size")), "sizes")
    quality = spark.createDataFrame(list(labels), "doc_id long, quality int")
    return docs, quality, source_mix.mix(sized, quality)


def test_targets_and_budgets(spark):
    r = random.Random(4)
    rows = [(k, f"s{r.randint(0, 3)}" if k % 11 else None, "w " * r.randint(0, 90), 1, 2) for k in range(300)]
    rows += [(None, "s1", "x y z", 1, 2), (7, "s9", None, 1, 2), (8, "s9", "", 1, 2), (9, "tiny", "one", 1, 2), (10, "s1", "big " * 3_000, 1, 2), (10, "s1", "big " * 3_000, 1, 2)]
    docs, quality, out = mixed(spark, rows, [(k, k % 2) for k in range(0, 300, 3)] + [(3, 0)])
    got = out.collect()
    size = {}
    for x in got:
        size.setdefault(x.source, []).append(x.size)
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(map(sum, size.values()))
    while open_:  # share again by weight until none is above its cap
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sum(size[s])}
        for s in over or open_:
            target[s] = 2 * sum(size[s]) if over else weight[s] * level
            left -= target[s]
        open_ -= over or set(open_)
    for s in order:
        own = [x for x in got if x.source == s]
        assert all(abs(x.target - target[s]) < 1e-6 and x.source_size == sum(size[s]) and 0 <= x.taken <= 2 * x.size for x in own)
        assert abs(sum(x.taken for x in own) - target[s]) <= 1
    again = mixed(spark, rows, [(k, k % 2) for k in range(0, 300, 3)])[2].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = source_mix.mixed_documents(docs, quality)
    assert copies.columns == docs.columns
    words = copies.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"), F.min("size").alias("size")).collect()
    assert all(abs(w.n - target[w.source]) <= 1 and w.size == 1 for w in words)


def test_better_documents_are_taken_sooner(spark):
    rows = [(k, "a", "w " * 10, 1, 2) for k in range(2_000)] + [(10_000 + k, "b", "w " * 10, 1, 2) for k in range(6_000)]
    _, _, out = mixed(spark, rows, [(k, int(k < 11_000)) for k in range(10_000, 16_000)])
    b = [x for x in out.collect() if x.source == "b"]
    share = lambda own: sum(x.taken for x in own) / sum(x.size for x in own)
    assert share([x for x in b if x.doc_id < 11_000]) > share([x for x in b if x.doc_id >= 11_000]) + 0.1


def test_mix_of_nothing(spark):
    docs, quality, out = mixed(spark, [])
    assert out.count() == 0 and source_mix.mixed_documents(docs, quality).count() == 0


BENCH = [
    (0, "A train leaves Paris at 7 with 120 people and travels 40 km before it meets 7 cars near the old stone bridge"),
    (1, "plain words without any slots that form a rather short question about nothing in particular today"),
    (2, "two words"),
    (3, None),
    (None, "another item whose id is null but whose words are quite distinct from all the others here"),
]


def hits(spark, rows, bench=None):
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, pos int, h string")
    items = spark.createDataFrame(BENCH if bench is None else bench, "item_id long, text string")
    got = decontamination.contaminated(docs, items).collect()
    return docs, items, {(r.doc_id, r.item_id): r.reparameterised for r in got}


def test_leaks_and_reparameterised_leaks(spark):
    noise = " ".join(random.Random(1).choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=400))
    moved = BENCH[0][1].replace("Paris", "Rome").replace(" 7 ", " 12 ").replace("120", "95").replace("40 km", "15 miles")
    mixed_up = BENCH[0][1].replace("at 7 ", "at 9 ").replace("120", "9").replace("40", "8").replace("meets 7", "meets 3").replace("Paris", "Rome")
    rows = [
        (1, f"{noise} {BENCH[0][1]} {noise}"), (2, f"{noise}. {moved}. {noise}"), (3, noise), (4, None), (5, ""), (6, "so TWO, words!"), (7, noise + " " + " ".join(BENCH[1][1].split()[:8])),
        (None, BENCH[1][1]), (8, f"{noise} {BENCH[4][1]}"), (8, noise), (9, "1 2 3 4 5 6 7 8 9 " * 5_000), (10, f"{noise} " * 40 + BENCH[1][1]), (11, mixed_up),
    ]
    docs, items, got = hits(spark, rows)
    assert {k: v for k, v in got.items() if k[0] not in (6,)} == {(1, 0): False, (2, 0): True, (None, 1): False, (8, None): False, (10, 1): False, **({(11, 0): True} if (11, 0) in got else {})}
    assert (6, 2) in got
    clean = decontamination.decontaminate(docs, items)
    assert clean.columns == docs.columns and {3, 4, 5, 7, 9} <= {r.doc_id for r in clean.collect()} <= {3, 4, 5, 7, 9, 11}


def test_recall_of_reparameterised_and_case_changed_items(spark):
    """Items whose numbers, names and units are replaced, consistently, or whose case is changed, in long texts."""
    r = random.Random(12)
    names, units = ["Paris", "Rome", "Alice", "Robert", "Berlin", "Maria"], ["km", "miles", "kg", "hours", "euros"]
    common = [w.lower() for w in "train leaves travels before meets cars near old stone bridge carries boxes each filled with apples sold every week while clerk counts them again when market opens".split()]
    bench = []
    for k in range(60):
        w = [r.choice(common) for _ in range(30)]
        for at, slot in ((4, str(r.randint(2, 99))), (5, r.choice(units)), (11, r.choice(names)), (17, str(r.randint(100, 999))), (24, r.choice(names))):
            w[at] = slot
        bench.append((k, " ".join(w)))

    def moved(text):
        other = {x: r.choice([y for y in names if y != x]) for x in names} | {x: r.choice([y for y in units if y != x]) for x in units}
        return " ".join(other.get(w, str(int(w) + 1_000) if w.isdigit() else w) for w in text.split())

    noise = lambda: " ".join(r.choice(common) for _ in range(120))
    shapes = {"moved": moved, "lower": str.lower, "upper": str.upper, "cut": lambda t: " ".join(t.split()[:28])}
    rows = [(100 * n + k, f"{noise()} {shape(t)} {noise()}") for n, shape in enumerate(shapes.values()) for k, t in bench]
    rows += [(9_000 + k, noise() + " " + noise()) for k in range(60)]
    got = hits(spark, rows, bench)[2]
    assert all(i % 100 == k for i, k in got), "clean texts and other items are left alone"
    for n, name in enumerate(shapes):
        assert sum((100 * n + k, k) in got for k, _ in bench) >= 0.9 * len(bench), name
    assert all(got[k, k] for k, _ in bench if (k, k) in got) and not any(got[100 + k, k] for k, _ in bench if (100 + k, k) in got)


def test_decontamination_of_nothing(spark):
    assert hits(spark, [])[2] == {} and hits(spark, [(1, "a b c d e f g")], [])[2] == {}


def test_planted_leaks_are_found(spark):
    out = decontamination.op7_decontamination(spark, "/root/testdata/sf0.01").collect()
    want = duckdb.sql("SELECT DISTINCT doc_id FROM '/root/testdata/sf0.01/documents.parquet' d, '/root/testdata/sf0.01/benchmark.parquet' b WHERE contains(d.text, b.text)").fetchall()
    assert {r.doc_id for r in out} == {w[0] for w in want}


def test_licenses_equal_exact_containment(spark):
    r = random.Random(6)
    noise = lambda n: " ".join(r.choice("alpha beta gamma delta epsilon the under license") for _ in range(n))
    names = sorted(license_scan.TEMPLATES)
    rows = [(k, f"{noise(r.randint(0, 90))}\n{license_scan.TEMPLATES[names[k % len(names)]].upper()}.\n{noise(r.randint(0, 90))}") for k in range(3 * len(names))]
    rows += [(900, None), (901, ""), (902, "mit license"), (None, license_scan.TEMPLATES["MIT"]), (903, noise(30_000) + " " + license_scan.TEMPLATES["ISC"]), (904, "x"), (904, license_scan.TEMPLATES["MIT"])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, win int, size int")
    got = {(x.doc_id, x.license) for x in license_scan.scan(docs).collect()}
    grams = lambda t: {tuple(w[i : i + 3]) for w in [license_scan.words_of(t or "")] for i in range(len(w) - 2)}
    known = {k: grams(t) for k, t in license_scan.TEMPLATES.items()}
    assert got == {(i, k) for i, t in rows for k, g in known.items() if len(g & grams(t)) >= 0.8 * len(g)}
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_many_templates_are_joined_without_literals(spark, monkeypatch):
    r = random.Random(61)
    docs = spark.createDataFrame([(k, " ".join(r.choice("alpha beta gamma delta under") for _ in range(40)) + " " + t) for k, t in enumerate(license_scan.TEMPLATES.values())], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, license_scan.scan(docs).collect()))
    want = rows()
    monkeypatch.setattr(license_scan, "LITERALS", 0)
    assert rows() == want and len(want) >= len(license_scan.TEMPLATES)


def test_short_notices_are_found_in_long_texts(spark):
    r = random.Random(16)
    noise = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(150))
    docs = spark.createDataFrame([(k, f"{noise()} All rights reserved. {noise()}") for k in range(60)] + [(99, noise())], "doc_id long, text string")
    assert {(x.doc_id, x.license, x.containment) for x in license_scan.scan(docs).collect()} == {(k, "reserved-short", 1.0) for k in range(60)}


def told(text, model):
    """Whether a language has half of the posterior, by sums over all segmentations in exact arithmetic."""
    from fractions import Fraction
    from functools import cache

    import regex

    def chance(word, p):
        @cache
        def rest(i):
            if i == len(word):
                return Fraction(1)
            return sum(Fraction(q) * rest(j) for j in range(i + 1, min(len(word), i + 12) + 1) if (q := p.get(word[i:j], 1e-9 if j == i + 1 else None)))

        return rest(0)

    total = [1] * len(model)
    for w in regex.findall(r"\p{L}+", (text or "").lower()):
        total = [t * _log_free(chance, w, p) for t, p in zip(total, model.values(), strict=True)]
        scale = max(total)
        total = [t / scale for t in total]
    return bool(regex.search(r"\p{L}", text or "")) and max(total) >= 0.5 * sum(total)


def _log_free(chance, w, p, memo={}):  # noqa: B006
    key = (w, id(p))
    if key not in memo:
        memo[key] = chance("▁" + w, p)
    x = memo[key]
    return float(x) if x > 1e-200 else x


def kept_near(rows):
    """The least doc_id of each component of texts whose five-word shingles have a similarity of 0.8."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if comp[a] != comp[b] and 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[comp[k]] = min(least.get(comp[k], i), i)
    return set(least.values())


def test_pipeline_stages_match_brute_force(spark):
    from oncelog.llm import language_id

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    everything = [(r.doc_id, r.text) for r in docs.collect()]
    model = language_id.train(docs, language_id.default_vocabulary())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        kept[name] = [tuple(r) for r in docs.collect()]
    assert {r[0] for r in kept["language"]} == {i for i, t in everything if told(t, model)}
    assert {r[0] for r in kept["near_dedup"]} == kept_near([r[:2] for r in kept["language"]])
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    verbatim = {r[0] for r in kept["near_dedup"] if any(t in r[1] for t in items)}
    assert {r[0] for r in kept["near_dedup"]} - {r[0] for r in kept["decontamination"]} == verbatim
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total, took = {}, {}
    for r in kept["decontamination"]:
        total[r[3]] = total.get(r[3], 0) + words(r[1])
    for r in kept["mix"]:
        took[r[3]] = took.get(r[3], 0) + words(r[1])
    assert all(took[s] <= 2 * total[s] for s in took) and abs(sum(took.values()) - 1.5 * sum(total.values())) <= len(total)
    texts = {r[0]: r[1] for r in kept["decontamination"]}
    assert all(texts[r[0]].startswith(r[1]) for r in kept["mix"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    ids = plain_ids([r[1] for r in kept["mix"]])
    crc = lambda x: zlib.crc32(np.array([*x, 2], dtype="<u4").tobytes())
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == sorted((r[0], len(x) + 1, crc(x)) for r, x in zip(kept["mix"], ids, strict=True))


SMALL = "doc_id long, text string, lang string, source string, n_chars long, _ord string, size string, key string, _hit string, scored string"


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_stages_take_odd_rows(spark, empty):
    """Nulls in any column, repeated rows and ids, ties, an empty table and clashing names."""
    r = random.Random(5)
    text = lambda k: " ".join(random.Random(k).choices("the cat sat on a mat and the dog ran home over hills".split(), k=60))
    rows = [(1, text(1), "en", "a"), (1, text(1), "en", "a"), (1, text(2), "en", "a"), (None, text(3), "en", None), (None, text(3), "en", None), (2, None, None, "b"), (3, "", "en", "b"), (4, "12 34", "fr", None)]
    rows += [(10 + k, text(100 + k), "en" if k % 2 else None, r.choice(["a", "b", None])) for k in range(20)] + [(99, "le chat " * 20_000, "fr", "b")]
    docs = spark.createDataFrame([] if empty else [(*x, len(x[1] or ""), "o", "s", "k", "h", "c") for x in rows], SMALL)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == before.columns
        kept.append(docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    if empty:
        assert not any(kept) and not out
        return
    assert {2, 3, 4}.isdisjoint({x.doc_id for x in kept[0]}) and len(kept[0]) == len(rows) - 3
    near = [(x.doc_id, x.text) for x in kept[1]]
    assert len(near) == len(set(near)) == len(rows) - 5 and {x.key for x in kept[1]} == {"k"}
    assert len(out) == len(kept[3])


@pytest.mark.parametrize("name", ["op5_source_mix", "op9_exact_dedup"])
def test_sql_agrees(spark, name):
    from oncelog.llm.registry import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    text = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    got = sorted(tuple(text(r[c]) for c in columns) for r in out.collect())
    assert got == sorted(tuple(text(x) for x in r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())


def test_texts_are_encoded_in_groups_of_bounded_bytes():
    import pyarrow as pa

    texts = ["word " * 500, "中文 " * 400, "", "x"] * 1_500
    batches = [pa.record_batch([pa.array(range(k, k + 3_000), pa.int64()), pa.array(texts[k : k + 3_000])], names=["doc_id", "text"]) for k in (0, 3_000)]
    groups = list(token_output._text_groups(iter(batches)))
    assert [(d, t) for g in groups for d, t, _ in g] == list(enumerate(texts))
    assert len(groups) == 4 and all(sum(len(t.encode()) for _, t, _ in g[:-1]) < 2_000_000 for g in groups)
