"""Nearest neighbours against all products; fingerprints against their definitions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import digests, hilbert_search, queries, words


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys = hilbert_search.hilbert_keys(grid, 3)
    assert len(np.unique(hilbert_keys)) == 512
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def recall(frame, found, k=20):
    rows = {}
    for r in frame.collect():
        good = r.embedding is not None and len(r.embedding) == 64 and all(x is not None and np.isfinite(x) for x in r.embedding)
        if r.vec_id is not None and good and any(r.embedding):
            rows[r.vec_id] = np.array(r.embedding, float)
    ids, points = np.array(list(rows)), np.stack(list(rows.values()))
    hits = total = 0
    for query, part in found.toPandas().groupby("query_id"):
        part = part.sort_values("rank")
        products = points @ rows[query]
        products[ids == query] = -np.inf
        best = np.lexsort((ids, -products))[:k]
        best = ids[best[np.isfinite(products[best])]]
        assert part["rank"].tolist() == list(range(1, len(best) + 1))
        score = dict(zip(ids, products))
        assert all(abs(score[i] - s) < 1e-9 for i, s in zip(part.vec_id, part.score))
        assert part.score.is_monotonic_decreasing
        hits, total = hits + len(set(best) & set(part.vec_id)), total + len(best)
    return hits / total


def vectors(spark):
    chance = np.random.default_rng(0)
    rows = [(i, (chance.standard_normal(64) * chance.uniform(0.1, 5)).tolist(), 1) for i in range(400)]
    rows += [(440, None, 1), (460, [0.0] * 64, 1), (480, [float("nan")] + [1.0] * 63, 1), (500, [1.0] * 3, 1)]
    rows += [(520, [None] + [1.0] * 63, 1), (None, [1.0] * 64, 1), (540, [float("inf")] * 64, 1), (560, rows[3][1], 1)]
    return spark.createDataFrame([*rows, (561, rows[3][1], 1)], "vec_id long, embedding array<double>, key int").repartition(3)


def test_search(spark):
    frame = vectors(spark)
    found = hilbert_search.search(frame, F.col("vec_id") % 20 == 0, tile=16)
    assert {r.query_id for r in found.collect()} == {*range(0, 400, 20), 560}
    assert recall(frame, found) >= 0.9
    few = frame.filter("vec_id < 5")
    assert hilbert_search.search(few, F.col("vec_id") == 0).count() == 4
    assert hilbert_search.search(few.filter("vec_id > 9"), F.col("vec_id") == 0).count() == 0


def test_search_query(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op3_hilbert_search(spark, folder)
    assert recall(spark.read.parquet(f"{folder}/embeddings.parquet"), found) >= 0.9


def test_recall_of_many_tiles(spark):
    """Tiles far smaller than the table, so that windows decide what is found."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = hilbert_search.search(frame, F.col("vec_id") % 20 == 0, tile=64)
    assert recall(frame, found) >= 0.9


def whole(rows):
    """Integer vectors, so that products are exact: the 20 best of all, by product and then by id."""
    known = {i: v for i, v, _ in rows}
    ids, points = np.array(list(known)), np.array(list(known.values()))
    out = {}
    for i in ids[ids % 20 == 0]:
        near = points @ np.array(known[i])
        out[i] = [j for j in ids[np.lexsort((ids, -near))] if j != i][:20]
    return out


def nearest(frame, **options):
    out = {}
    for r in hilbert_search.search(frame, F.col("vec_id") % 20 == 0, **options).orderBy("rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_lists_do_not_depend_on_ranges(spark, monkeypatch):
    """One range a tile, ranges of several tiles, and queries in groups give the same finds."""
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")

    def found():
        rows = hilbert_search.search(frame, F.col("vec_id") % 20 == 0, tile=32, reach=0.1)
        return sorted(map(tuple, rows.collect()))

    usual = found()
    monkeypatch.setattr(hilbert_search, "RANGES", 1000)
    assert found() == usual
    monkeypatch.setattr(hilbert_search, "RANGES", 1)
    monkeypatch.setattr(hilbert_search, "ASKS", 7)
    assert found() == usual
    monkeypatch.setattr(hilbert_search, "RANGE_ROWS", 100)
    assert found() == usual


def test_running_lists():
    chance = np.random.default_rng(3)
    row, near = chance.integers(0, 9, 800), chance.integers(0, 60, 800)
    score = chance.integers(0, 6, 800).astype(float)
    got = hilbert_search.best_of(row, near, score, 5)
    for i in range(9):
        best = {}
        for j, s in zip(near[row == i], score[row == i]):
            best[j] = max(s, best.get(j, s))
        want = sorted((-s, j) for j, s in best.items())[:5]
        assert [(-s, j) for j, s in zip(got[1][got[0] == i], got[2][got[0] == i])] == want


@pytest.mark.parametrize("options", [{}, {"tile": 64, "reach": 0.5}])
def test_equal_vectors_and_repeated_rows(spark, options):
    """Groups larger than k, scattered over the files, and rows that stand three times."""
    chance = np.random.default_rng(2)
    points = chance.integers(-9, 10, (700, 64)).astype(float)
    points[:300] = np.sign(points[:300])  # many ties of unequal vectors
    rows = [(int(i), point.tolist(), 1) for i, point in zip(chance.permutation(700), points)]
    copied = [(int(i), rows[650][1], 1) for i in chance.permutation(np.arange(1000, 1500))]
    schema = "vec_id long, embedding array<double>, key int"
    frame = spark.createDataFrame(rows + copied, schema).repartition(3)
    assert nearest(frame, **options) == whole(rows + copied)
    assert nearest(spark.createDataFrame(3 * rows, schema).repartition(3), **options) == whole(rows)


def test_tile_keeps_the_best_ids():
    chance = np.random.default_rng(5)
    points = chance.integers(-1, 2, (900, 8)).astype(float)  # few vectors, so ties abound
    ids, asks = chance.permutation(np.arange(900) // 3), chance.integers(-1, 2, (40, 8)).astype(float)
    row, found, score = hilbert_search.Tile(ids, points).best(asks, 21)
    for i, ask in enumerate(asks):
        known = {}
        for j, near in zip(ids, points @ ask):
            known[j] = max(near, known.get(j, -np.inf))
        best = sorted((-near, j) for j, near in known.items())[:21]
        assert [(-s, j) for j, s in zip(found[row == i], score[row == i])] == best


def test_entropy_bins():
    data = np.random.default_rng(1).integers(97, 110, 3000).astype(np.uint8)
    data[500:700] = 97
    for at in range(0, len(data) - 63, 7):
        share = np.bincount(data[at : at + 64])
        share = share[share > 0] / 64
        assert abs(digests.entropy_bins(data)[at] - -(share * np.log2(share)).sum() / 6 * 1000) <= 0.51


def rows():
    chance = np.random.default_rng(4)
    long = ["".join(chance.choice(list("abcdefgh "), size)) for size in (70, 127, 300, 5000, 60_000, 12)]
    made = [(i, text) for i, text in enumerate(long)]
    return [*made, (10, None), (11, ""), (12, "é你😀"), (3, long[3]), (3, long[3]), (20, long[3]), (None, "null id"), (None, long[2])]


@pytest.mark.parametrize("partitions", [1, 4])
def test_following_texts(spark, partitions):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, kind string, k1 int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = digests.with_next(docs.repartition(partitions)).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found) == len(rows())
    texts = {(i, len(t or "")): t or "" for i, t in rows()}
    known = [i for i, _ in rows() if i is not None]
    line = sorted({i for i in known}, reverse=True)
    for r in found:
        own = texts[r.doc_id, r.n_chars]
        if r.doc_id is not None and known.count(r.doc_id) == 1 and r.doc_id != line[-1]:
            after = next(t or "" for i, t in rows() if i == line[line.index(r.doc_id) + 1])
            assert r.edited_sha256 == hashlib.sha256(digests.edited(own, after).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == "") == (own == "")
    same = {r.fingerprint for r in found if r.doc_id in (3, 20)}
    assert len(same) == 1


def test_short_texts():
    """Texts that hold few neighbourhoods of windows are told apart, and near their own edited form."""
    chance = np.random.default_rng(6)
    ranks = np.arange(digests.BINS, -1, -1)
    near, far = [], []
    for size in range(127, 700, 3):
        one, two = ("".join(chance.choice(list("abcdefghijklmnop "), size)) for _ in range(2))
        own, changed, other = digests._chains([one, digests.edited(one, two), two], ranks)
        assert digests.as_text(own)
        near.append(digests.likeness(own, changed))
        far.append(digests.likeness(own, other))
    assert min(near[:120]) > 0.4 and np.mean(near) > 0.5 and np.mean(far) < 0.1
    dashes, stars, spaces, noted = digests._chains(["-" * 200, "*" * 5000, " " * 700, "-" * 5000 + "a"], ranks)
    assert digests.as_text(dashes) and digests.as_text(spaces)
    assert digests.likeness(dashes, stars) < 0.2 and digests.likeness(stars, spaces) < 0.2
    assert 0 < digests.likeness(dashes, noted) <= 1


def words_of(chance, size):
    text = ""
    while len(text) < size:
        text += "".join(chance.choice(list("etaoinshrdlucmfwypvbg"), chance.integers(2, 10))) + chance.choice([" ", " ", " ", ", ", ". "])
    return text[:size]


def test_likeness_across_sizes():
    """A text beside its first two thirds and beside itself with one byte more, at all sizes."""
    chance = np.random.default_rng(8)
    ranks = np.arange(digests.BINS, -1, -1)
    parts, longer, changed = {}, {}, {}
    for size in [*range(200, 2000, 25), *range(500, 775, 3)]:
        text, other = words_of(chance, size), words_of(chance, size)
        own, part, more, after = digests._chains([text, text[: size * 2 // 3], text + "q", digests.edited(text, other)], ranks)
        parts[size], longer[size] = digests.likeness(own, part), digests.likeness(own, more)
        changed[size] = digests.likeness(own, after)
    across = [size for size in parts if 512 <= size < 768]  # the text on one side of the bound, its part on the other
    assert min(parts[size] for size in across) > 0.5 and np.mean([parts[size] for size in across]) > 0.85
    assert min(parts.values()) > 0.5 and min(longer.values()) > 0.8
    assert np.mean([changed[size] for size in across]) > 0.45
    short, long = words_of(chance, 400), words_of(chance, 900)
    assert digests.likeness(*digests._chains([short, long], ranks)) < 0.3


def plain_fingerprint(text, ranks):
    """Both chains by their definition, one window after the other."""
    data = text.encode()
    size, wide = len(data), digests.WINDOW

    def entropy(at):
        share = np.bincount(np.frombuffer(data[at : at + wide], np.uint8))
        share = share[share > 0] / wide
        return int(-(share * np.log2(share)).sum() * digests.BINS / np.log2(wide) + 0.5)

    bins = [entropy(at) for at in range(size - wide + 1)]
    points = {}
    groups = max(0, len(bins) - wide + 1)
    for first in range(groups):
        best = min(range(first, first + wide), key=lambda at: (ranks[bins[at]], at))
        points[best] = points.get(best, 0) + 1
    enough = min(digests.POINTS, groups)
    at = sorted(i for i, n in points.items() if n >= enough and bins[i] >= digests.LEAST_BIN)
    windows = list(dict.fromkeys(data[i : i + wide] for i in at))
    short = min(digests.SHORT, size)
    stretches = list(dict.fromkeys(data[i : i + short] for i in range(size - short + 1))) if size else []
    return windows, stretches if size < digests.LEAST_BYTES or len(windows) < digests.FEW else []


def test_features_by_definition():
    """Counts of features and the filters they fill, against a construction without arrays over all texts."""
    chance = np.random.default_rng(9)
    ranks = np.random.default_rng(10).permutation(digests.BINS + 1)
    texts = [words_of(chance, size) for size in (0, 1, 7, 8, 9, 63, 64, 126, 127, 300, 511, 512, 900, 3000)]
    texts += ["ab" * 400, "-" * 600, "é你" * 120]
    for text, found in zip(texts, digests._chains(texts, ranks)):
        for features, chain in zip(plain_fingerprint(text, ranks), found):
            assert len(chain) == -(-len(features) // digests.FILTER_FEATURES)
            bits = np.zeros_like(chain)
            for i, feature in enumerate(features):
                signs = np.frombuffer(feature, np.uint8).astype(np.uint64) + np.uint64(1)
                (key,) = words.stretches(signs, np.array([0]), np.array([len(signs)]))
                for part in range(digests.HASHES):
                    bits[i // digests.FILTER_FEATURES, int(key) >> 9 * part & 511] = 1
            assert (bits == chain).all()
        assert digests.likeness(found, digests.from_text(digests.as_text(found))) == 1.0


def test_single_text_follows_itself(spark):
    (row,) = digests.with_next(spark.createDataFrame([(1, "abc" * 60)], "doc_id long, text string")).collect()
    assert row.near_next == 1.0
    assert digests.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digest_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    docs = docs.sort_values("doc_id", ascending=False)
    found = queries.op8_digests(spark, sf_dir).toPandas().set_index("doc_id").loc[docs.doc_id]
    texts = docs.text.tolist()
    changed = [digests.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    assert found.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    assert found.n_chars.tolist() == [len(t) for t in texts]
    assert found.near_edited.mean() > 0.55 > 0.2 > found.near_next.mean()
    chain = [digests.from_text(f) for f in found.fingerprint]
    near = [digests.likeness(a, b) for a, b in zip(chain, chain[1:] + chain[:1])]
    assert np.allclose(near, found.near_next)
