"""Operators against brute force, round trips and planted cases on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, decontam, language, lzprint, neardup, packing, passages, queries, sharding, store, textcore, toxicity

DOCS = "doc_id long, text string, lang string"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, n=5):
    w = words_of(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def sentence(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def test_word_sets_are_exact():
    texts = ["A b  c D e f", None, "", " x", "a b c d e f", "one two", "\t", "é É\x0bz q r s t u", "a b c d e f"]
    found = [(int(b - a)) for _, _, _, bounds in neardup.shingle_sets(pa.array(texts)) for a, b in itertools.pairwise(bounds.tolist())]
    assert found == [len(shingles(t)) for t in texts]
    assert textcore.words(*textcore.flat(pa.array(texts)))[2].tolist()[-1] == sum(len(words_of(t)) for t in texts)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = [sentence(rng, 120) for _ in range(4)]
    texts = [None, "", "two words", "two words", "Two WORDS"]
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            texts.append(" ".join(w))
    texts += [sentence(rng, 60) for _ in range(20)]
    rows = [(7 * i + 3, t, "x") for i, t in enumerate(texts)]
    sets = {i: shingles(t) for i, t, _ in rows}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            group[y] = x
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in sets}
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(6)
    passage = sentence(rng, 70)
    fuzzy = passage.split()
    fuzzy[20], fuzzy[45] = "changed", "also"
    docs = [(1, sentence(rng, 80) + " " + passage + " " + sentence(rng, 40), "a"), (2, passage + " " + sentence(rng, 90), "a"), (3, sentence(rng, 30) + " " + " ".join(fuzzy), "a"), (4, sentence(rng, 200), "a"), (5, None, "a"), (6, "", None), (None, passage, "a")]
    df = spark.createDataFrame(docs, DOCS)
    found = passages.repeated_passages(df)
    got = {(r["doc_id"], r["origin_doc_id"]): (r["first_word"], r["end_word"]) for r in found.collect()}
    assert got[2, 1] == (0, 70) and got[3, 1] == (30, 100) and not any(d in (1, 4) for d, _ in got)
    left = {r["doc_id"]: r["text"] for r in passages.without_passages(df, found).collect()}
    assert passage in left[1] and passage not in left[2] and len(left[2].split()) == 90 and len(left[3].split()) == 30 and left[5] is None
    assert passages.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_near_short_shared_phrases(spark):
    rng = random.Random(16)
    for n in (9, 12, 16):  # a shared line, n other words on both sides, then the passage
        line, passage = sentence(rng, 12), sentence(rng, 60)
        docs = [(1, f"{sentence(rng, 80)} {line} {sentence(rng, n)} {passage} {sentence(rng, 40)}", "a"), (2, f"{sentence(rng, 33)} {line} {sentence(rng, n)} {passage} {sentence(rng, 40)}", "a")]
        found = [(r["first_word"], r["end_word"]) for r in passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()]
        assert len(found) == 1 and found[0][0] <= 45 + n and found[0][1] == 105 + n
    x, y, same, line = (np.arange(k, k + 200) for k in (1000, 2000, 3000, 4000))
    x, y = (np.concatenate([z[:10], same[:52], z[10:32], line[:12], z[32:50]]) for z in (x, y))
    assert passages.align(x, y, [(10, 62, 10), (84, 96, 84)], 48, 0.8) == passages.align(x, y, [(10, 96, 10)], 48, 0.8) == [(10, 62, 10, 62, 52)]


@pytest.mark.parametrize("every", [5, 6, 8])
def test_fuzzy_passages_are_found(spark, every):
    rng = random.Random(every)
    docs, edited = [], {}
    for i in range(100):
        words = sentence(rng, 60, 10**6).split()
        fuzzy = [w for k, x in enumerate(words) for w in ([x] if (k + 1) % every else rng.choice([["new"], [], [x, "new"]] if every > 5 else [["new"]]))]
        docs.append((i, f"{sentence(rng, 50, 10**6)} {' '.join(words)} {sentence(rng, 50, 10**6)}", "a"))
        docs.append((1000 + i, f"{sentence(rng, 40, 10**6)} {' '.join(fuzzy)} {sentence(rng, 70, 10**6)}", "a"))
        edited[1000 + i] = i
    got = {(r["doc_id"], r["origin_doc_id"]) for r in passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert got <= set(edited.items()) and len(got) >= 95


def test_passage_behind_an_unrelated_first_origin(spark):
    rng = random.Random(21)
    passage = sentence(rng, 60, 10**6).split()
    scattered = " ".join(" ".join(passage[i : i + 6]) + " " + sentence(rng, 90, 10**6) for i in range(60))
    fuzzy = [w if (i + 1) % 10 else "new" for i, w in enumerate(passage)]
    docs = [(0, scattered, "a"), (1, " ".join(passage), "a"), (2, " ".join(fuzzy), "a")]
    got = {(r["doc_id"], r["origin_doc_id"]) for r in passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {(2, 1)}


def test_passage_between_unrelated_documents(spark):
    rng = random.Random(22)
    passage = sentence(rng, 60, 10**6).split()
    scattered = [" ".join(" ".join(passage[i : i + 6]) + " " + sentence(rng, 90, 10**6) for i in range(60)) for _ in range(2)]
    fuzzy = [w if (i + 1) % 10 else "new" for i, w in enumerate(passage)]
    docs = [(0, scattered[0], "a"), (1, " ".join(passage), "a"), (2, scattered[1], "a"), (3, " ".join(fuzzy), "a")]
    got = {(r["doc_id"], r["origin_doc_id"]) for r in passages.repeated_passages(spark.createDataFrame(docs, DOCS), every=True).collect()}
    assert got == {(3, 1)}


@pytest.mark.parametrize("crowd", [2, 70])
def test_passage_behind_many_other_partners(spark, crowd):
    rng = random.Random(31)
    passage = sentence(rng, 60, 10**6).split()
    scattered = lambda: " ".join(" ".join(passage[i : i + 6]) + " " + sentence(rng, 90, 10**6) for i in range(0, 60, 1 if crowd == 2 else 3))
    fuzzy = [w if (i + 1) % 10 else "new" for i, w in enumerate(passage)]
    docs = [(i, scattered(), "a") for i in range(crowd)] + [(crowd // 2 + 1000, " ".join(passage), "a")]
    docs += [(2000 + i, scattered(), "a") for i in range(crowd)] + [(5000, " ".join(fuzzy), "a")]
    got = {(r["doc_id"], r["origin_doc_id"]) for r in passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {(5000, crowd // 2 + 1000)}


def test_substring_stage_cuts_passages_behind_other_partners(spark):
    import corpus_pipeline

    rng = random.Random(34)
    passage = sentence(rng, 60, 10**6).split()
    scattered = lambda: " ".join(" ".join(passage[i : i + 6]) + " " + sentence(rng, 90, 10**6) for i in range(0, 60, 3))
    fuzzy = [w if (i + 1) % 10 else "new" for i, w in enumerate(passage)]
    rest = sentence(rng, 70, 10**6)
    texts = [*(scattered() for _ in range(20)), " ".join(passage), *(scattered() for _ in range(20)), " ".join(fuzzy) + " " + rest]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_stage(spark, docs, "").collect()}
    assert {i: t for i, t in left.items() if i < 41} == dict(enumerate(texts[:41])) and len(left[41].split()) <= 71 and rest in left[41]


def test_copies_of_a_common_passage_are_not_paired_with_each_other(spark):
    rng = random.Random(32)
    passage = sentence(rng, 60, 10**6)
    docs = [(i, f"{sentence(rng, 60, 10**6)} {passage} {sentence(rng, 60, 10**6)}", "a") for i in range(80)]
    found = passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {r["doc_id"]: r["end_word"] - r["first_word"] for r in found} == dict.fromkeys(range(1, 80), 60) and len(found) <= 240  # of 3,160 pairs


def test_partner_pairs_are_those_of_all_pairs():
    rng = np.random.default_rng(33)
    size, short, side = 12, 4, passages.side_words(12, 4)
    for turn in range(6):
        n, words = 60, 6 if turn % 2 else 40
        doc, free = np.sort(rng.integers(0, 30, n)), rng.random(n) < 0.7
        left, right = (np.repeat(rng.integers(0, words, (n // 4, side)), 4, axis=0).astype(np.int32) for _ in range(2))
        order = rng.permutation(n)
        left, right = left[order], right[order]
        for x in (left, right):
            edited = rng.random(x.shape) < 0.1
            x[edited] = rng.integers(0, words, int(edited.sum()))
            for i, end in enumerate(rng.integers(0, side + 1, n)):
                if i % 3 == 0:
                    x[i, end:] = 256 + i
        group = rng.integers(0, 2, n)
        got = {pair for x, y in passages.partner_pairs(group, doc, free, left, right, short, size, 0) for pair in zip(x.tolist(), y.tolist(), strict=True)}
        for i in range(n):
            for j in range(n):
                if group[i] != group[j] or doc[j] >= doc[i] or not free[i]:
                    assert (i, j) not in got
                    continue
                runs = [int(np.argmax(np.append(x[i] != x[j], True))) for x in (left, right)]
                if sum(runs) + short >= size:
                    continue  # given with the first that has the words
                near = False
                for x, e in zip((left, right), runs, strict=True):
                    three = [{tuple(x[k, a : a + 3]) for a in range(e, e + passages.MAX_GAP + 1) if x[k, a : a + 3].max() < 256} for k in (i, j)]
                    near |= x[i, e] < 256 and x[j, e] < 256 and bool(three[0] & three[1])
                assert ((i, j) in got) == near


def test_insides_of_periodic_runs_are_no_origins_and_covered(spark):
    rng = random.Random(35)
    sizes = [100, *(rng.randrange(40, 100) for _ in range(38)), 150]
    docs = [(i, f"{sentence(rng, 60, 10**6)} {'ab ' * n}{'cd ' * 30}{sentence(rng, 60, 10**6)}", "a") for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(docs, DOCS)
    covered = {}
    for r in passages.repeated_passages(frame).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["end_word"]))
    assert covered == {i: set(range(60, 90 + n)) for i, n in enumerate(sizes) if i}
    slim, n = frame.selectExpr("doc_id AS _id", "text AS _text"), 3
    words = passages.word_blobs(slim, 48, n)
    matched = passages.match_blobs(passages.seed_blobs(slim, 48, 0.8, n), n).filter(f"kind != {passages.MATCHES}")
    opened = passages.open_blobs(matched, words, words.limit(0), 4, 48, n, True).filter(f"kind = {passages.AROUND}").collect()
    places = sum(len(passages.blobs.decode(r["blob"])[0]) for r in opened)
    assert 0 < places < sum(sizes) / 2


def test_partner_pairs_that_agree_are_those_of_all_pairs():
    rng = np.random.default_rng(36)
    size, short, side, least, rows = 12, 4, passages.side_words(12, 4), 9, 60
    seen = 0
    for _ in range(2):
        doc, free, inner = np.sort(rng.integers(0, 30, rows)), rng.random(rows) < 0.7, rng.random(rows) < 0.2
        left, right = (np.repeat(rng.integers(0, 40, (rows // 4, side)), 4, axis=0).astype(np.int32) for _ in range(2))
        for x in (left, right):
            edited = rng.random(x.shape) < 0.15
            x[edited] = rng.integers(0, 40, int(edited.sum()))
        got = {pair for x, y in passages.partner_pairs(np.zeros(rows, dtype=int), doc, free, left, right, short, size, least, inner) for pair in zip(x.tolist(), y.tolist(), strict=True)}
        both = np.concatenate([left[:, ::-1], np.zeros((rows, short), dtype=np.int32), right], axis=1)
        for i, j in itertools.product(range(rows), repeat=2):
            runs = [int(np.argmax(np.append(x[i] != x[j], True))) for x in (left, right)]
            run = sum(runs) + short
            if run >= size:
                continue  # given with the first that has the words
            near = False
            for x, e in zip((left, right), runs, strict=True):
                grams = lambda k, n: [tuple(x[k, a : a + n]) for a in range(e, min(e + passages.MAX_GAP, side - n) + 1)]  # noqa: E731,B023
                threes = sum(u == v for u in grams(i, 3) for v in grams(j, 3))
                near |= bool(set(grams(i, short)) & set(grams(j, short))) or (run >= 2 * short and threes + (run >= least - 6) * (threes > 0) >= 2)
            drift = passages.DRIFT + passages.MAX_GAP
            equal = np.array([word in both[j, max(at - drift, 0) : at + drift + 1] for at, word in enumerate(both[i])])
            agree = max(equal[a : a + size].sum() for a in range(len(equal) - size + 1)) >= least
            seen += (expected := bool(doc[j] < doc[i] and free[i] and not inner[j] and near and agree))
            assert ((i, j) in got) == expected
    assert seen > 10


def test_freed_memory_goes_back_at_the_end_of_a_task():
    from pathlib import Path

    from gridloom.llm import store

    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    held = []

    def run(batches):
        parts = [np.ones(12_500) for _ in range(3_000)]
        held.append(np.ones(12_500))  # lies behind them, so that the heap can't just end earlier
        yield from batches
        del parts

    before = resident()
    assert list(store.returning(run)(iter([]))) == [] and resident() - before < 100_000_000


def test_periodic_texts_have_few_passages(spark):
    rng = random.Random(23)
    docs = [(1, f"{sentence(rng, 60)} {'ab cd ' * 44}", "a"), (2, f"{sentence(rng, 70)} {'ab cd ' * 225} {sentence(rng, 50)}", "a")]
    found = passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert set().union(*(range(r["first_word"], r["end_word"]) for r in found)) >= set(range(70, 515)) and len(found) <= 12


def test_fewest_passages_cover_the_same_words():
    rng = random.Random(24)
    for _ in range(200):
        spans = [(a := rng.randrange(30), a + rng.randrange(1, 12)) for _ in range(rng.randrange(1, 9))]
        rows = np.array([(d, a, b, 5, a, b, b - a) for a, b in spans for d in (7, 8)], dtype=np.int64)
        kept = passages.fewest(rows)
        covered = set().union(*(range(a, b) for a, b in spans))
        least = next(k for k in range(1, 9) if any(set().union(*(range(a, b) for a, b in some)) == covered for some in itertools.combinations(spans, k)))
        for d in (7, 8):
            own = [(a, b) for x, a, b, *_ in kept.tolist() if x == d]
            assert set().union(*(range(a, b) for a, b in own)) == covered and len(own) == least
    assert passages.fewest(np.empty((0, 7), dtype=np.int64)).shape == (0, 7)


def test_chains_score_like_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        runs = sorted({(s := rng.randrange(40), s + rng.randrange(3, 9), rng.randrange(40)) for _ in range(7)})

        def score(chain):
            total = 0.0
            for k, (s, e, a) in enumerate(chain):
                total += e - s
                if k:
                    ps, pe, pa_ = chain[k - 1]
                    if pe > s or pa_ + pe - ps > a:
                        return -1e9
                    total -= passages.GAP_COST * ((s - pe) + (a - (pa_ + pe - ps)))
            return total

        best = max(score(c) for k in range(1, 5) for c in itertools.combinations(runs, k))
        assert score(passages.chains(runs)[0]) == pytest.approx(max(best, score(passages.chains(runs)[0])))


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, 15 + 4 * i)) for i in range(9)] + [(90, None), (91, "too short"), (92, "")]
    edited = items[6][1].split()
    edited[9] = "other"
    docs = [(1, sentence(rng, 301) + " " + items[0][1].upper() + ", " + sentence(rng, 50), "a"), (2, sentence(rng, 7) + " " + " ".join(edited), "a"), (3, sentence(rng, 500), "a"), (4, None, "a"), (5, "", "a"), (6, items[8][1], "a")]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 0), (2, 6), (6, 8)} and got[1, 0] == got[6, 8] == 0 < got[2, 6]


def test_leak_in_a_document_that_begins_inside_an_item(spark):
    rng = random.Random(13)
    items = [(i, sentence(rng, 50)) for i in range(20)]
    docs = [(j, f"{' '.join(t.split()[8:])} {sentence(rng, 40 + j % 7)}" if j % 2 else sentence(rng, 60 + j), "a") for j, (_, t) in enumerate(x for item in items for x in (item, item))]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(2 * i + 1, i) for i in range(20)}


@pytest.mark.parametrize("low, high", [(15, 20), (20, 40), (40, 70)])
def test_leaks_at_tolerance_are_found(spark, low, high):
    rng = random.Random(low)
    word = lambda: f"w{rng.randrange(10**5, 10**6)}"
    items, docs = [], []
    for i in range(200):
        words = [word() for _ in range(rng.randrange(low, high))]
        edited = [[x] for x in words]
        for k in rng.sample(range(len(words)), len(words) // 5):
            edited[k] = rng.choice([[word()], []])
        items.append((i, " ".join(words)))
        docs.append((i, " ".join([*(word() for _ in range(rng.randrange(30))), *itertools.chain(*edited), *(word() for _ in range(30))]), "a"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(i == j for i, j in got) and len(got) >= 190


def test_short_and_unspaced_items_are_found(spark):
    rng = random.Random(17)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = [(1, "Seven short words are in this item"), (2, "Paris!"), (3, han(60)), (4, han(5)), (5, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-/", k=120)))]
    wrong = items[2][1]
    wrong = f"{wrong[:20]}x{wrong[21:40]} {wrong[41:]}"
    docs = [(1, sentence(rng, 40) + " seven SHORT words, are in this item. " + sentence(rng, 9), "a"), (2, "to paris and back", "a"), (3, han(70) + wrong + han(33), "a"), (4, han(11) + items[3][1] + han(20), "a"), (5, sentence(rng, 8) + " a" + items[4][1] + " " + sentence(rng, 5), "a"), (6, "seven short words are not in this item", "a"), (7, han(300), "a")]
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"], r["distance"]) for r in decontam.find_leaks(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (40, 46, 0), (2, 2): (1, 1, 0), (3, 3): (0, 1, 2), (4, 4): (0, 0, 0), (5, 5): (8, 8, 0)}


def test_stages_decide_by_row(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    item = store.table(spark, sf, "benchmark").filter("text is not null").first()["text"]
    rng = random.Random(18)
    copy, other = sentence(rng, 60), sentence(rng, 60)
    rows = [(None, item), (1, copy), (1, copy), (None, copy), (2, other), (3, copy)]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination_stage(spark, docs, sf).collect()]
    assert (None, item) not in clean and len(clean) == 5
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()]
    assert sorted(kept, key=str) == sorted([(None, item), (1, copy), (None, copy), (2, other)], key=str)


def test_edit_distance_of_best_place():
    rng = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(60):
        item, region = ([rng.randrange(3) for _ in range(rng.randrange(1, n))] for n in (7, 12))
        d, a, b = decontam.best_place(np.array(item), np.array(region))
        assert d == min(distance(item, region[x:y]) for x in range(len(region) + 1) for y in range(x, len(region) + 1)) == distance(item, region[a:b])


def test_fingerprints(spark):
    def naive(codes):
        seen, phrases, at = set(), [], 0
        for end in range(1, len(codes) + 1):
            if tuple(codes[at:end]) not in seen:
                seen.add(tuple(codes[at:end]))
                phrases.append(end)
                at = end
        return phrases

    rng = random.Random(1)
    texts = [sentence(rng, rng.randrange(1, 90), 12) for _ in range(30)] + ["", None, "aaaaaaaaaaaaaaaaaaaaaaaa", "日本語のテキスト" * 9]
    for t in texts:
        codes = lzprint.units(np.frombuffer((t or "").encode("utf-32-le"), dtype=np.uint32))[1].tolist()
        assert lzprint.parse(codes, {}) == naive(codes)
    rows = [(3 * i, t, "x") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in lzprint.fingerprint_with_next(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    plain = [t or "" for t in texts]
    assert len(got) == len(rows)
    for i, t in enumerate(plain):
        following = plain[(i + 1) % len(plain)]
        e = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[3 * i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == lzprint.fingerprints([t, e])
    assert lzprint.fingerprint_with_next(spark.createDataFrame([], DOCS)).count() == 0
    assert lzprint.fingerprint_with_next(spark.createDataFrame([(1, "alone text here", "x")], DOCS)).first()["near_next"] == 1.0


def test_near_copies_without_blanks_have_like_fingerprints():
    rng = random.Random(12)
    text = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(3000))
    a, b = (set(lzprint.Parsed(t).hashes.tolist()) for t in (text, "x" + text))
    assert len(a & b) > 0.9 * len(a | b)


def test_chat_round_trip():
    rng = random.Random(9)
    parts = ["</s>", "[INST]", "<s>", "\\", "[/INST]", "<\\s>", "x", "\n", "", "é", "<", "["]
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "system", "[INST]"]), "".join(rng.choices(parts, k=rng.randrange(6)))) for _ in range(rng.randrange(1, 6))]
        out = chat.render_incrementally(turns, chat.marked_template)
        assert chat.read_marked(out.formatted) == turns and out.rewritten_at == -1
        assert "".join(chat.unescape(out.formatted[a:b]) for a, b in out.loss) == "".join(t for r, t in turns if r == "assistant")
        assert out.spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(out.spans))
    rewriting = lambda turns: f"({len(turns)})" + chat.marked_template(turns)
    assert chat.render_incrementally([("user", "a"), ("assistant", "b")], rewriting).rewritten_at == 0


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 0, None, None), (None, 1, "user", "x"), (1, None, "system", "s")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\na\nassistant\nb\n").hexdigest()
    assert got[1]["loss_chars"] == 1 and got[2]["n_turns"] == 1 and None in got


def test_shards(spark):
    rng = random.Random(0)
    m = sharding.communication_matrix([rng.randrange(50) for _ in range(40)], 7, 3)
    columns = [sum(c) for c in zip(*m, strict=True)]
    assert max(columns) - min(columns) <= 1 and min(min(r) for r in m) >= 0
    draws = [sharding._hypergeometric(rng, 30, 50, 20) for _ in range(4000)]
    assert np.mean(draws) == pytest.approx(7.5, abs=0.15) and np.var(draws) == pytest.approx(20 * 0.375 * 0.625 * 60 / 79, rel=0.15)
    rows = [(i // 2, "t") for i in range(1001)] + [(None, "n"), (None, None)] + [(7, "t")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shuffle_to_shards(df.repartition(3)).collect()
    per = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert sorted(len(x) for x in per.values()) == [162] + [163] * 7 and all(x == list(range(len(x))) for x in per.values())
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    assert max(Counter(r["shard"] for r in got if r["doc_id"] == 7).values()) < 70  # copies spread
    assert sorted(map(str, got)) == sorted(map(str, sharding.shuffle_to_shards(df.repartition(7, "text")).collect()))
    assert sharding.shuffle_to_shards(df.limit(0)).count() == 0
    for name in ("shard", "SLOT", "_shuffle_n"):
        with pytest.raises(ValueError):
            sharding.shuffle_to_shards(df.withColumn(name, F.lit(1)))


def test_hypergeometric_law_at_any_size():
    from math import comb

    for good, bad, draws in ((30, 50, 20), (5, 900, 300), (400, 30, 200)):
        p, total = draws / (good + bad), comb(good + bad, draws)
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            found = np.exp(sharding._log_binomial(k, good, p) + sharding._log_binomial(draws - k, bad, p) - sharding._log_binomial(draws, good + bad, p))
            assert found == pytest.approx(comb(good, k) * comb(bad, draws - k) / total, rel=1e-9)
    rng = random.Random(4)
    draws = [sharding._hypergeometric(rng, 10**10, 7 * 10**10, 10**5) for _ in range(400)]
    assert np.mean(draws) == pytest.approx(12500, abs=20) and np.var(draws) == pytest.approx(12500 * 7 / 8, rel=0.25)


def test_null_ids_and_repeated_rows_link(spark):
    rng = random.Random(41)
    a, b = sentence(rng, 80).split(), sentence(rng, 80).split()
    near = [*a[:79], "other"]
    rows = [(None, " ".join(a)), (None, " ".join(near)), (5, " ".join(b)), (5, " ".join(b)), (4, " ".join([*b[:79], "x"]))] + [(9, " ".join(near))] * 40
    got = [(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)).collect()]
    assert Counter(got) == Counter([(None, 9)] * 2 + [(9, 9)] * 40 + [(5, 4)] * 2 + [(4, 4)])
    nameless = neardup.near_duplicates(spark.createDataFrame([(None, t, "x") for t in (" ".join(a), " ".join(near), " ".join(b))], DOCS))
    assert [r["component_id"] for r in nameless.collect()] == [None] * 3


def test_repeated_ids_and_clashing_columns_in_passages(spark):
    rng = random.Random(43)
    passage = sentence(rng, 60)
    one, two = f"{passage} {sentence(rng, 30)}", f"{sentence(rng, 20)} {passage}"
    docs = spark.createDataFrame([(1, one, "a"), (1, one, "a"), (2, two, "b"), (2, two, "b")], "doc_id long, text string, _doc string").withColumn("seed", F.lit(1)).withColumn("p", F.lit("x"))
    found = passages.repeated_passages(docs)
    assert [(r["doc_id"], r["first_word"], r["end_word"], r["origin_doc_id"]) for r in found.collect()] == [(2, 20, 80, 1)]
    left = passages.without_passages(docs, found)
    assert left.columns == docs.columns and sorted(len(r["text"].split()) for r in left.collect()) == [20, 20, 90, 90]


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    rng = random.Random(3)
    odd = [" ", "\n", "\t", "\x0b", "a", "'s", "B1", "é", "中", " ", " ", "　", "\x1c", "\u0085", "!?", "\\", "\x00", "<|endoftext|>", "😀", "'ll", "7"]
    texts = [None, "", *("".join(rng.choices(odd, k=rng.randrange(25))) for _ in range(400)), sentence(rng, 3000)]
    ids = [hf.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.Encoder(*queries.vocabulary()).texts(pa.array(texts))] == ids
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = packing.pack(df, *queries.vocabulary(), with_ids=True).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, want in enumerate(ids):
        assert [x for r in sorted(pieces[i], key=lambda r: r["start"]) for x in r["ids"]] == [*want, 0]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    ends = {k: sum(n for _, n in v) for k, v in by.items()}
    assert all(a[0] + a[1] == b[0] for v in by.values() for a, b in itertools.pairwise(sorted(v)))
    assert sorted(ends) == list(range(len(ends))) and all(n == 1024 for k, n in ends.items() if k < max(ends))
    assert packing.pack(df.limit(0), *queries.vocabulary()).count() == 0


def test_trailing_white_space_is_encoded_alone():
    encode = packing.Encoder(*queries.vocabulary())
    for end, begin in itertools.product(("\n", "\n\n", " ", "\t \n"), ("\n\nfoo", "  bar", "\n \n\tbaz", "\n\nThe", "   qux")):
        encode.empty()  # a block of two chunks beside x
        texts = ["x" + end, "x" + begin]
        assert [i.tolist() for i in encode.texts(pa.array(texts))] == [encode.encoding.encode_ordinary(t) for t in texts]


def test_language(spark):
    rows = [(1, "the cat and the dog and the house", "en"), (2, "der hund und die katze und das haus", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "the end", None)]
    df = spark.createDataFrame(rows, DOCS)
    profiles = language.learn_profiles(df)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(df, profiles).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "en"}
    assert language.predict_language(df, {}).filter("lang_pred <> 'und'").count() == 0


def test_classifiers_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in store.table(spark, sf, "labels").collect()}
    found = {r["doc_id"]: r for r in queries.op7_ftrl_quality(spark, sf).collect()}
    held = [(r["predicted"], labels[i]["quality"]) for i, r in found.items() if r["held_out"] and i in labels]
    assert np.mean([p == y for p, y in held]) > 0.95
    toxic = {r["doc_id"]: r for r in queries.op1_nnpu_toxicity(spark, sf).collect()}
    clean = [r["predicted"] for i, r in toxic.items() if i in labels and not labels[i]["toxic"]]
    assert len(found) == len(toxic) == 1000 and np.mean(clean) < 0.02
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x")], DOCS)
    assert toxicity.score_toxicity(df, toxicity.train_toxicity(df, none)).count() == 2


@pytest.mark.xfail(reason="open: 33 toxic training rows in four languages give 0.79 at sf0.01", strict=False)
def test_toxicity_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in store.table(spark, sf, "labels").collect()}
    toxic = {r["doc_id"]: r for r in queries.op1_nnpu_toxicity(spark, sf).collect()}
    pos, neg = ([r["score"] for i, r in toxic.items() if i in labels and labels[i]["toxic"] == y and r["held_out"]] for y in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) > 0.8  # area under the curve


def test_leaks_of_twelve_words_and_cut_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "UNITS_PER_PASS", 1500)
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(10**5, 10**6)}"
    items, docs = [], []
    for i in range(200):
        words = [word() for _ in range(12 if i < 100 else 60)]
        edited = list(words)
        if i < 100:
            for k in rng.sample(range(12), 2):
                edited[k] = word()
        else:  # cut at the start or the end of the document
            edited = words[8:] if i % 2 else words[:-8]
        before, after = ([word() for _ in range(rng.randrange(20, 40))] for _ in range(2))
        if i >= 100:
            before, after = ([], after) if i % 2 else (before, [])
        items.append((i, " ".join(words)))
        docs.append((i, " ".join([*before, *edited, *after]), "a"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(spark.createDataFrame(docs, DOCS).coalesce(2), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(i == j for i, j in got) and len([i for i, _ in got if i < 100]) >= 90 and len([i for i, _ in got if i >= 100]) >= 95


def test_leaks_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "some text", "a")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, sentence(random.Random(1), 20)), (1, sentence(random.Random(1), 20))], "item_id long, text string")
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.find_leaks(docs.limit(0), items).count() == 0
