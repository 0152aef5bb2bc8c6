"""What tiles of early shingles hand on: only sets that can meet, and every pair once for a task."""

import numpy as np
import pyarrow as pa

from pairloom.llm import ngram_join


def brute(h, n, most):
    pairs = {(i, j) for i in range(len(h)) for j in range(len(h)) if i != j and h[i] == h[j]}
    return {(i, j) for i, j in pairs if n[j] <= most[i] and n[i] <= most[j]}


def random_tiles(seed, rows):
    chance = np.random.default_rng(seed)
    h = np.sort(chance.integers(0, rows // 5 + 1, rows))
    n = chance.integers(1, 60, rows)
    most = (n - chance.integers(0, 1 + n // 4)) * 175 // 75 - n
    return h, n, most


def test_sets_that_meet_no_other_leave_the_tile():
    for seed in range(60):
        h, n, most = random_tiles(seed, 1 + seed)
        order = np.lexsort((n, h))
        h, n, most = h[order], n[order], most[order]
        want = {i for i, _ in brute(h, n, most)}
        assert set(np.flatnonzero(ngram_join.meeting(h, n, most)).tolist()) == want


def test_small_tiles_hand_on_their_pairs_whatever_the_batches():
    h, n, most = random_tiles(7, 120)
    want = brute(h, n, most)
    able = {i for i, _ in want}
    sizes = {t: sum(1 for i in able if h[i] == t) for t in set(h.tolist())}
    table = pa.table({"h": h, "sid": np.arange(120), "n": n, "most": most})
    for size in (1, 7, 120):
        found = list(ngram_join._meeting(4)(iter(table.to_batches(max_chunksize=size))))
        rows = [row for batch in found for row in batch.to_pylist()]
        pairs = [(r["sid"], r["other"]) for r in rows if r["other"] is not None]
        assert sorted(pairs) == sorted((i, j) for i, j in want if i < j and sizes[h[i]] < 4)
        kept = [(r["sid"], r["size"]) for r in rows if r["other"] is None]
        assert sorted(kept) == sorted((i, sizes[h[i]]) for i in able if sizes[h[i]] >= 4)


def test_pairs_of_a_task_are_held_once(monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_HELD", 10)
    pairs = ngram_join.PairsHeld()
    for _ in range(100):
        assert not pairs.add(np.array([5, 1]), np.array([2, 3]))
    assert [side.tolist() for side in pairs.take()] == [[1, 2], [3, 5]]
    assert [side.tolist() for side in pairs.take()] == [[], []]


def test_likeness_is_found_at_the_first_shared_place(spark):
    """Sets at the least overlap, whose first shared shingle stands as late as it can."""
    texts = []
    for extra in range(1, 40):
        shared = [f"s{extra}.{i}" for i in range(60)]
        texts += [(f"{extra}a", " ".join(shared)), (f"{extra}b", " ".join(shared + [f"t{extra}.{i}" for i in range(extra)]))]
    rows = [(i, text) for i, (_, text) in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.near_groups(frame).collect()}
    for at in range(0, len(rows), 2):
        small, large = (len(rows[i][1].split()) - 4 for i in (at, at + 1))
        assert found[at + 1] == (at if 100 * small >= 75 * large else at + 1)


def test_sets_come_back_from_packed_ranges(monkeypatch):
    """Dealt out by few or many rows, the sets of shared tiles return in order, and sets alone in a tile do not."""
    chance = np.random.default_rng(5)
    lists = [np.sort(chance.integers(0, 1 << 12, chance.integers(0, 30)).astype(np.uint64) << np.uint64(50)) for _ in range(300)]
    lists[7] = np.sort(np.concatenate([lists[7], lists[7] + np.uint64(1)]))  # two shingles of one name
    n = [4 * len(x) + 1 for x in lists]
    sets = pa.table({"sid": np.arange(300) + (5 << 33), "n": n, "rare": [x.view(np.int64).tolist() for x in lists]})
    want = {}
    for sid, own in enumerate(lists):
        for place, h in enumerate((own >> np.uint64(16)).tolist()):
            want.setdefault(h, {}).setdefault(sid + (5 << 33), (n[sid], (n[sid] - place) * 175 // 75 - n[sid]))
    want = sorted((h, sid, *rest) for h, found in want.items() if len(found) > 1 for sid, rest in found.items())
    assert len(want) > 1000
    for rows in (1, 50, 1 << 19):
        monkeypatch.setattr(ngram_join, "DEALT_ROWS", rows)
        dealt = pa.concat_tables(pa.Table.from_batches([b]) for b in ngram_join._dealing(13, 48)(iter(sets.to_batches())))
        back = ngram_join._undealt(75)(iter(dealt.sort_by("tiles").to_batches(max_chunksize=3)))
        found = [tuple(r.values()) for b in back for r in b.to_pylist()]
        assert [r[0] for r in found] == sorted(r[0] for r in found) and sorted(found) == want


def test_packed_rows_take_few_bytes():
    """Nearly all sets are alone in a tile; what tells them to the shuffle is under half of its plain bytes."""
    rows = np.zeros(20_000, ngram_join.PLACED)
    rows["h"] = np.sort(np.random.default_rng(1).integers(0, 1 << 48, len(rows)))
    rows["sid"] = (9 << 33) + np.random.default_rng(2).integers(0, 4000, len(rows))
    rows["n"], rows["place"] = 450, np.arange(len(rows)) % 110
    data = ngram_join.packed(rows)
    assert (ngram_join.unpacked(data, ngram_join.PLACED) == rows).all()
    assert len(pa.compress(data, "lz4", asbytes=True)) < 12 * len(rows)


def test_second_round_takes_what_the_first_one_left(spark, monkeypatch):
    """Of two near copies in a tile the first round hands on their only pair; sets of a chain, with more pairs, wait for the second."""
    monkeypatch.setattr(ngram_join, "FEW", 2)
    asked = []
    pairs = ngram_join._pairs

    def watched(large, sets, groups, alike):
        asked.append(large.select("sid").distinct().count())
        return pairs(large, sets, groups, alike)

    monkeypatch.setattr(ngram_join, "_pairs", watched)
    rows = []
    for twin in range(20):
        shared = [f"t{twin}.{i}" for i in range(80)]
        rows += [(2 * twin, " ".join(shared)), (2 * twin + 1, " ".join([*shared, f"e{twin}"]))]
    for step in range(12):
        rows.append((100 + step, " ".join(f"c{i}" for i in range(4 * step, 4 * step + 80))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.near_groups(frame).collect()}
    assert all(found[2 * twin + 1] == 2 * twin for twin in range(20))
    assert {found[100 + step] for step in range(12)} == {100}
    assert asked[0] >= 52 and asked[1] <= 12
