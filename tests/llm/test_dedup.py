"""Exact, near and substring deduplication against brute force, and their edge cases."""

import hashlib
import random

import pytest

from oncelog.llm import exact_dedup, near_copies, simhash_dedup, substring_dedup
from oncelog.llm.common import Workspace
from oncelog.llm.graph import components

SCHEMA = "doc_id long, text string, kept string, fp string, digest string, s string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(n))


def docs(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)


EDGE = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (None, "a b"), (5, "A b"), (None, None), (6, words(5_000, 1)), (7, " "), (8, "x"), (8, "y")]


def test_exact_marks_every_row(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = exact_dedup.digests(docs(spark, EDGE))
    index.add(rows)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_duplicates(rows, index).collect()), key=str)
    want = []
    for i, t in EDGE:
        same = [j for j, u in EDGE if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep))
    assert got == sorted(want, key=str)


def test_exact_is_incremental(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.deduplicate(docs(spark, [(1, "a"), (2, "a"), (3, "b")]), index)
    assert sorted(r.doc_id for r in first.collect()) == [2, 3]
    second = exact_dedup.deduplicate(docs(spark, [(9, "a"), (10, "c")]), index)
    assert second.columns == SCHEMA.replace(",", "").split()[0::2]
    assert [r.doc_id for r in second.collect()] == [10]
    index.compact()
    assert sorted((r.keep_id, r.n) for r in index.rows().collect()) == [(3, 1), (9, 3), (10, 1)]


def test_exact_empty(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = exact_dedup.digests(docs(spark, []))
    index.add(rows)
    assert exact_dedup.mark_duplicates(rows, index).count() == 0


def brute_simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, fps):
    comp = {k: k for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(least.get(comp[k], i), i)
    return [least.get(comp[k]) for k in range(len(rows))]


@pytest.mark.parametrize("limit", [4_096, 2])
def test_simhash_components(spark, limit):
    base = words(300, 5).split()
    near = []
    for k in range(25):
        r, w = random.Random(k), list(base)
        for _ in range(k % 4):
            w[r.randrange(len(w))] = "zz"
        near.append((100 + k, " ".join(w)))
    rows = [*EDGE, *near]
    fps = [brute_simhash(t) for _, t in rows]
    got = simhash_dedup.cluster(docs(spark, rows), file_limit=limit).collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == sorted((str(i), f, str(c)) for (i, _), f, c in zip(rows, fps, brute_components(rows, fps), strict=True))


def test_simhash_keeps_one_of_each_group(spark):
    rows = [(3, words(200, 1)), (2, words(200, 1)), (2, words(200, 1)), (7, words(200, 2)), (9, None), (8, " ")]
    clashing = "doc_id long, text string, _ord string, ord string, th string, _th string"
    kept = simhash_dedup.deduplicate(spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], clashing))
    assert kept.columns == ["doc_id", "text", "_ord", "ord", "th", "_th"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8]
    assert simhash_dedup.deduplicate(docs(spark, [])).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def brute_near(rows):
    """The doc_ids that stay: the least of each component of equal or near texts; rows of equal doc_id and text are one."""
    rows = sorted({(float("inf") if i is None else i, t or "") for i, t in rows})
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if comp[a] != comp[b] and jaccard(rows[a][1], rows[b][1]) >= 0.8:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    return sorted((i, t) for k, (i, t) in enumerate(rows) if comp[k] == k)


def near_rows():
    rows = [*EDGE, (8, "x y z"), (50, "one two three four five six"), (51, "One two three four five six"), (50, words(90, 77)), (50, words(90, 78))]
    for k in range(40):
        base = words(180 + 5 * k, 1_000 + k).split()
        copy, r = list(base), random.Random(k)
        for _ in range(1 + k % 4):
            copy[r.randrange(len(copy))] = "replacement"
        rows += [(100 + 3 * k, " ".join(base)), (101 + 3 * k, " ".join(copy)), (102 + 3 * k, " ".join(base[: len(base) // 2] + words(len(base) // 2, 5_000 + k).split()))]
    base = words(250, 9).split()
    for k in range(40):  # a large group: each has one more edit than the one before, so that they link in a chain
        base[6 * k % 250] = f"edit{k}"
        rows.append((1_000 - k, " ".join(base)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"file_texts": 2}, {"block_texts": 3}, {"file_texts": 2, "block_texts": 3}])
def test_near_copies_match_a_full_comparison(spark, limits):
    rows = near_rows()
    want = brute_near(rows)
    kept = simhash_dedup.deduplicate(docs(spark, rows), **limits)
    assert kept.columns == SCHEMA.replace(",", "").split()[0::2]
    assert sorted((float("inf") if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect()) == want


@pytest.mark.parametrize("pivots, few, gain", [(2, 3, 0.0), (64, 1, 0.1), (3, 0, 0.9)])
def test_large_blocks_match_a_full_comparison(spark, pivots, few, gain):
    r, sets = random.Random(3), []
    for block in range(3):
        base = list(range(1_000 * block, 1_000 * block + 40))
        for _ in range(25):
            own = list(base)
            for _ in range(r.randrange(1, 6)):
                own[r.randrange(40)] = r.randrange(10_000, 10_060)
            sets.append((block, sorted(set(own))))
    comp = list(range(len(sets)))
    for a, (p, x) in enumerate(sets):
        for b, (q, y) in enumerate(sets[:a]):
            if p == q and len({*x} & {*y}) >= 0.8 * len({*x} | {*y}):
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    members = spark.createDataFrame([(b, k, len(x), [0] * 7, x) for k, (b, x) in enumerate(sets)], "block long, node long, size int, lanes array<long>, grams array<long>")
    work = Workspace(spark)
    got = {r.node: r.component for r in near_copies._search_large(work.write(members, "members"), work, pivots, few, gain).collect()}
    assert [got.get(k, k) for k in range(len(sets))] == comp
    assert {got[k] for k in got} and len(set(comp)) < len(sets)


def test_hot_sketches_need_no_file_or_distance(spark):
    texts = [words(120, 4) + f" {k}" for k in range(30)]
    kept = simhash_dedup.deduplicate(docs(spark, list(enumerate(texts))), file_texts=2, block_texts=4)
    assert [r.doc_id for r in kept.collect()] == [0]


def test_recall_of_near_copies(spark):
    """Of the pairs at 0.8 or more in a table, 0.95 are in one group at the least."""
    pairs, rows = 0, []
    for k in range(400):
        base = words(60 + k, 9_000 + k).split()
        copy, r = list(base), random.Random(k)
        while True:
            trial = list(copy)
            trial[r.randrange(len(trial))] = "zz"
            if jaccard(" ".join(base), " ".join(trial)) < 0.8:
                break
            copy = trial
        if copy != base:
            pairs += 1
            rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    gone = len(rows) - simhash_dedup.deduplicate(docs(spark, rows)).count()
    assert pairs > 350 and gone >= 0.95 * pairs


def test_long_text_fingerprint():
    text = words(20_000, 3)
    assert simhash_dedup.fingerprint(text) == brute_simhash(text)


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1_000, 1_001), (1_001, 1_000), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(path, Workspace(spark)).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1_000: 1_000, 1_001: 1_000}
    assert components(path.where("a > 9999"), Workspace(spark)).count() == 0


def brute_substring(rows, window=50):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        rank = float("inf") if i is None else i
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, float("inf")), rank)
    out = []
    for i, t in rows:
        w, rank = (t or "").encode().split(), float("inf") if i is None else i
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < rank:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def overlap_rows():
    passage, line = words(160, 7), words(60, 8)
    rows = list(EDGE)
    for k in range(20, 34):
        p = passage.split()[k - 20 : 150 - 3 * (k % 5)]
        rows.append((k, "\n".join([words(40, k), " ".join(p), line if k % 2 else "", words(30, 99 + k), line if k % 3 == 0 else ""])))
    rows += [(40, rows[-1][1]), (40, passage + " " + line), (None, passage), (41, "one two " * 200), (42, "one two " * 60)]
    return rows


def judged(spark, batches):
    everything = docs(spark, [r for b in batches for r in b])
    index = substring_dedup.WindowIndex(everything)
    covered = None
    for b in batches:
        own = index.add(docs(spark, b))
        covered = own if covered is None else covered.unionByName(own)
    out = substring_dedup.judge(everything, covered).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out), index


def test_substring_in_one_batch(spark):
    rows = overlap_rows()
    assert judged(spark, [rows])[0] == brute_substring(rows)


def test_substring_in_batches_with_compaction(spark):
    rows = sorted(overlap_rows(), key=lambda r: float("inf") if r[0] is None else r[0])
    cuts = [rows[:14], rows[14:17], rows[17:20], rows[20:23], rows[23:]]
    # rows of one doc_id stay in one batch
    assert all({i for i, _ in a}.isdisjoint({i for i, _ in b} - {None}) for k, a in enumerate(cuts) for b in cuts[k + 1 :])
    got, index = judged(spark, cuts)
    assert got == brute_substring(rows)
    assert len(index.log.runs) < substring_dedup.FANOUT


def test_substring_of_texts_that_repeat_themselves(spark):
    p, line = words(130, 21).split(), words(70, 22)
    near = p[:60] + ["changed"] + p[61:]
    rows = [(1, " ".join(near)), (2, " ".join(p + p)), (3, words(30, 23) + " " + line), (4, "\n".join([line, words(20, 24), line, words(9, 25), line]))]
    rows += [(5, " ".join(near + near)), (6, " ".join(p[5:] + p[3:])), (6, " ".join(p[5:] + p[9:])), (7, " ".join(p[20:90] * 3))]
    assert judged(spark, [rows])[0] == brute_substring(rows)
    assert judged(spark, [rows[:1], rows[1:4], rows[4:]])[0] == brute_substring(rows)


def forget(spark, log):
    """What a new session knows: no table, only the files."""
    for run in log.runs:
        spark.sql(f"DROP TABLE {run}")


def test_indexes_are_opened_by_name(spark):
    index = exact_dedup.DigestIndex(spark, "digests_kept", buckets=3)
    index.add(exact_dedup.digests(docs(spark, [(1, "a"), (2, "b")])))
    index.add(exact_dedup.digests(docs(spark, [(3, "a"), (4, "c")])))
    forget(spark, index.log)
    again = exact_dedup.DigestIndex(spark, "digests_kept", buckets=3)
    assert [r.doc_id for r in exact_dedup.deduplicate(docs(spark, [(9, "a"), (8, "d")]), again).collect()] == [8]
    again.compact()
    forget(spark, again.log)
    assert sorted((r.keep_id, r.n) for r in exact_dedup.DigestIndex(spark, "digests_kept").rows().collect()) == [(2, 1), (4, 1), (8, 1), (9, 3)]

    passage = words(80, 31)
    rows = [(1, passage), (2, words(60, 32)), (3, passage + " x"), (4, "y " + words(60, 32))]
    everything = docs(spark, rows)
    index = substring_dedup.WindowIndex(everything, "windows_kept")
    covered = index.add(docs(spark, rows[:2]))
    forget(spark, index.log)
    covered = covered.unionByName(substring_dedup.WindowIndex(everything, "windows_kept", fanout=2).add(docs(spark, rows[2:])))
    out = substring_dedup.judge(everything, covered).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out) == brute_substring(rows)
    assert len(substring_dedup.WindowIndex(everything, "windows_kept").log.runs) == 1


def thue_morse(n, a, b):
    return [(b if bin(k).count("1") % 2 else a) for k in range(n)]


def test_substring_of_words_that_weak_hashes_confuse(spark):
    one, two = "".join(thue_morse(2_048, "a", "b")), "".join(thue_morse(2_048, "b", "a"))
    noise = words(60, 41).split()
    rows = [(1, " ".join(noise + [one])), (2, " ".join(noise[:40] + [two] + noise[:9])), (3, " ".join(thue_morse(200, "x", "y"))), (4, " ".join(thue_morse(200, "y", "x"))), (5, " ".join([two] + noise))]
    assert judged(spark, [rows])[0] == brute_substring(rows)


def test_substring_empty(spark):
    assert judged(spark, [[]])[0] == []
