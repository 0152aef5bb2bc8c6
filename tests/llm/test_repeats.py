"""Near copies and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import ngram_join, queries, substring_dedup, words
from pairloom.llm.components import components


def brute_groups(rows, width=5, alike=75):
    sets = []
    for _, text in rows:
        parts = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        grams = {tuple(parts[p : p + width]) for p in range(len(parts) - width + 1)}
        sets.append(grams or ({tuple(parts)} if parts else set()))
    shared, holders = Counter(), defaultdict(list)
    for i, grams in enumerate(sets):
        for gram in grams:
            shared.update((j, i) for j in holders[gram])
            holders[gram].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), count in shared.items():
        if 100 * count >= alike * (len(sets[a]) + len(sets[b]) - count):
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)), key=str)


def near_texts():
    chance, rows = random.Random(7), []
    for i in range(150):
        if rows and chance.random() < 0.6:
            parts = chance.choice(rows)[1].split()
            for _ in range(chance.randint(0, 3)):
                if parts:
                    parts[chance.randrange(len(parts))] = chance.choice("abAB")
            rows.append((i, " ".join(parts)))
        else:
            rows.append((i, " ".join(chance.choice("abcd") for _ in range(chance.randint(0, 60)))))
    rows += [(500, None), (501, ""), (502, " "), (503, "One two"), (504, "one  TWO"), (505, "É a b c d"), (506, "é a b c d")]
    return [*rows, rows[3], (None, rows[4][1]), (None, "lonely words here"), (600, "w " * 5000)]


def frame(spark, rows):
    made = [(i, t, "x", 1, "n") for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, sig string, n int, source string").repartition(4)


SMALL = {"COMMON_LEAST": 5, "COUNT_LEAST": 1, "BLOCK": 7, "FEW": 3, "LEAST_BITS": 64}


@pytest.mark.parametrize("settings", [{}, SMALL, SMALL | {"TILE_BITS": 4}])
def test_near_groups(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    found = ngram_join.near_groups(frame(spark, near_texts())).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_groups(near_texts())


def test_one_of_each_group_stays(spark):
    rows = near_texts()
    kept = ngram_join.one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "sig", "n", "source"]
    kept = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    groups = brute_groups(rows)
    want = Counter(key for key, size, least in groups if size and key is not None and key == least)
    named = Counter(key for key, text in kept if (text or "").strip() and key is not None)
    assert named == Counter(set(want))
    assert [text for key, text in kept if key is None] == ["lonely words here"]
    assert {key for key, text in kept if not (text or "").strip()} >= {500, 501, 502}


def test_bounds_hold():
    chance = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(chance.integers(0, 300, chance.integers(1, 200)).astype(np.uint64) * np.uint64(2654435761))
        b = np.unique(chance.integers(0, 300, chance.integers(1, 200)).astype(np.uint64) * np.uint64(2654435761))
        bound = ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b))
        assert bound >= len(np.intersect1d(a, b))
    assert ngram_join.need(32, 75) == 14


def test_wider_bitmaps_are_folded_until_equal(spark, monkeypatch):
    """At low likeness partners can be four times as wide."""
    monkeypatch.setattr(ngram_join, "LEAST_BITS", 64)
    words = [f"w{i}" for i in range(1188)]
    rows = [(1, " ".join(words[:300])), (2, " ".join(words)), (3, "lonely text of very few words")]
    found = ngram_join.near_groups(frame(spark, rows), alike=20)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(1, 1), (2, 1), (3, 3)]
    sigs = [ngram_join.bitmap(np.arange(size, dtype=np.uint64)) for size in (296, 1184)]
    assert [len(sig) for sig in sigs] == [64, 256]
    pairs = list(ngram_join.tile_pairs(np.array([296, 1184]), sigs, lambda i, j: np.ones(len(i), bool), 20))
    assert [tuple(map(list, p)) for p in pairs] == [([0], [1], [296])]


def test_large_tile_keeps_one_partner_for_each_set():
    """8 million pairs of one tile are bounded in turns; what is held is one partner a set."""
    chance = np.random.default_rng(0)
    n = np.full(4000, 300)
    sigs = [chance.integers(0, 2**63, 16, np.uint64).tobytes() for _ in n]
    best, partner, most = np.full(4000, -1), np.full(4000, 1 << 62), 0
    for i, j, bound in ngram_join.tile_pairs(n, sigs, lambda i, j: np.ones(len(i), bool), 1):
        most = max(most, len(i))
        ngram_join.best_of(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([bound, bound]), best, partner)
    assert most <= 70_000 and (best >= 0).all()
    bits = np.unpackbits(np.frombuffer(b"".join(sigs), np.uint8).reshape(4000, -1), axis=1, bitorder="little").astype(np.int32)
    for place in (0, 17, 3999):
        shared = bits @ bits[place]
        bound = np.minimum(300 - (bits.sum(1) - shared), 300 - (bits[place].sum() - shared))
        bound[place] = -1
        assert best[place] == bound.max() and partner[place] == bound.argmax()


def test_groups_of_many_near_copies(spark):
    chance = random.Random(3)
    text = [f"t{i}" for i in range(200)]
    rows = [(9000, " ".join(f"s{i}" for i in range(200)))]
    for i in range(3000):
        copy = list(text)
        copy[chance.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    found = ngram_join.near_groups(frame(spark, rows)).collect()
    assert {r.component_id for r in found if r.doc_id < 9000} == {0} and len(found) == 3001
    assert [r.component_id for r in found if r.doc_id == 9000] == [9000]


def test_common_shingles(spark, monkeypatch):
    """Whatever stands often enough in a task is told with its count."""
    for name, value in {"COMMON_LEAST": 4, "COUNT_LEAST": 2, "COUNT_TOGETHER": 40}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = [(i, f"a b c d e x{i} y{i}") for i in range(30)] + [(99, None), (98, "")]
    texts = frame(spark, rows).select(F.col("text").alias("_text")).coalesce(1)
    found = ngram_join.common_shingles(texts, 5)
    shared = words.Words(np.array([0, 9]), np.frombuffer(b"a b c d e", np.uint8))
    assert found.tolist() == words.windows(shared.hashes(fold=True), 5).tolist()


def test_empty_tables(spark):
    empty = frame(spark, [(1, "a b c")]).filter("doc_id > 1")
    assert ngram_join.near_groups(empty).count() == 0
    assert ngram_join.one_of_each(empty).count() == 0
    assert substring_dedup.remove_repeats(empty, ["doc_id"]).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 70), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {70: 70, 80: 70, 90: 70}


def brute_repeats(rows, width):
    parts = [(i, (text or "").encode().split()) for i, text in rows]
    starts = Counter(tuple(w[p : p + width]) for _, w in parts for p in range(len(w) - width + 1))
    out = []
    for i, w in parts:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if starts[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_texts():
    chance, rows = random.Random(5), []
    for i in range(60):
        signs = "ab" if i % 3 else "0123456789"
        rows.append((i if i % 7 else None, " ".join(chance.choice(signs) for _ in range(chance.randint(0, 90)))))
    return [*rows, (1, None), (2, ""), (3, " \n"), rows[5], rows[5], (99, "x " * 3000), (98, "é b " * 50)]


@pytest.mark.parametrize("width, gram", [(5, 3), (8, 3), (35, 16)])
def test_repeats(spark, width, gram):
    found = substring_dedup.remove_repeats(frame(spark, repeat_texts()), ["doc_id"], width=width, gram=gram).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found]
    assert sorted(got, key=str) == brute_repeats(repeat_texts(), width)


def test_clean_texts_stay_as_they_are(spark):
    rows = [(1, "a  b\tc"), (2, None), (3, "p q r s t u"), (4, "p q r s t u v")]
    found = substring_dedup.without_repeats(frame(spark, rows), size="n", width=5, gram=3)
    assert found.columns == ["doc_id", "text", "sig", "n", "source"]
    assert {r.doc_id: (r.text, r.n) for r in found.collect()} == {1: ("a  b\tc", 1), 2: (None, 1), 3: ("", 0), 4: ("v", 1)}


def test_words_are_hashed_alike_in_any_slices(monkeypatch):
    texts = ["", "One two  three", "x" * 300 + " two", "\ttwo ONE", " ", "three " * 40, "äö two\x0bthree"]
    found = [text.encode() for text in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    read = words.Words(offsets, np.frombuffer(b"".join(found), np.uint8))
    for fold in (False, True):
        whole = read.hashes(fold)
        split = [word.lower() if fold and word.isascii() else word for text in found for word in text.split()]
        assert len(whole) == len(split) and len(set(whole.tolist())) == len(set(split))
        assert len(set(zip(whole.tolist(), split))) == len(set(split))
        for size in (1, 7, 64):
            monkeypatch.setattr(words, "SLICE", size)
            assert (read.hashes(fold) == whole).all()
            monkeypatch.undo()
    assert not len(words.Words(np.zeros(1, np.int64), np.zeros(0, np.uint8)).hashes())


def test_sliding_least():
    values = np.array([5, 3, 3, 9, 1, 4], np.uint64)
    assert words.sliding_least(values, 3).tolist() == [1, 1, 4, 4]


def test_queries(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op2_ngram_join(spark, sf_dir).collect()), key=str) == brute_groups(rows)
    assert sorted(map(tuple, queries.op6_substring_dedup(spark, sf_dir).collect()), key=str) == brute_repeats(rows, 35)
