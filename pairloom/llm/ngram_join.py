"""Link texts whose sets of word shingles are alike (Jaccard), exactly, and name the groups.

1. *Sets.* Each text becomes its distinct shingle hashes. Equal sets are one set from here on.
2. *Tiles.* In any one order of all shingles, two sets that are alike share a shingle among their first
   ``n - need + 1``. The order is by hash, with the shingles of very many texts last, so that common passages
   open no tiles. A tile holds the sets with the same early shingle, in order of size. In the first tile that two alike sets
   share, all that they share stands from that shingle on; so its place in a set bounds the size of the partners that the set
   can have there (``most``), and sets that can meet no other one leave the tile. Of larger tiles with the same members, as the
   shingles of a shared passage open, the first one stays. Tiles above ``BLOCK`` sets are cut into blocks that meet two by two.
3. *Signatures.* Each pair of a tile gets a bound of its overlap from hashed bitmaps: a bit that only one side has stands
   for a shingle that only this side has. Pairs whose bound is too low go.
4. *Exact.* The others are decided by the intersection of their sorted shingle arrays.

Tiles below ``FEW`` sets hand on all pairs that can meet. Of larger ones, whose sets bring their bitmaps along, a first round
hands on each set with the one of the best bound, which ties the sets of a large group to its centre; the second round
looks at the sets that had more pairs in a tile, and hands on those with a high enough bound whose sets are still in different
groups and that have not been decided. Alike sets meet in many tiles;
a pair with a common one among the ``LEAD`` least larger tiles of both is handed on by the least such one only. So no link
between groups is lost, and no group is expanded into its pairs.

Defined results: texts with fewer words than a shingle count as one shingle, texts without words (or null) are
empty sets, linked with nothing; equal texts share a group (the group's name is the least id); null ids are named
by null; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.llm import words
from pairloom.llm.common import discard, freeing, stored, text_key
from pairloom.llm.components import components
from pairloom.llm.pieces import blocks, buffers, spans

WIDTH = 5
ALIKE = 75  # per cent
COMMON_SHARE = 5000  # a shingle of more than one text in so many is common
COMMON_LEAST = 16
COUNT_LEAST = 3  # occurrences among the texts of one task that are worth telling
COUNT_TOGETHER = 4_000_000  # shingles of a task that are counted together
TEXT_BYTES = 1 << 19  # of texts that a task looks at together; their hashes take some forty times as much
BLOCK = 4096  # sets of a tile that meet in one block
FEW = 8  # sets of a tile whose pairs are all handed on
LEAST_BITS = 1024  # of a bitmap; larger sets have a bit for each member at least
PAIRS_TOGETHER = 100_000  # pairs of a tile that are bounded together, fewer where their bitmaps
TURN_BYTES = 8 << 20  # take more than this
TILE_BITS = 48  # of a shingle's hash that name its tile; sets that meet by chance are told apart like any others
DEALT_ROWS = 1 << 19  # sets in tiles that a task deals out together
RANGES = 4  # of tiles for each task that reads them
PAIRS_HELD = 500_000  # pairs of a task that are freed of repeats together
LEAD = 4  # larger tiles of a set that tell whether a pair belongs to another one
FILTER_BITS = 25  # places in the fixed-size filter of wanted texts


def need(total, alike: int):
    """Least overlap of two alike sets with ``total`` members in both together."""
    return -((-alike * total) // (100 + alike))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds."""
    found = words.Words(offsets, data)
    hashes = found.hashes(fold=True)
    rows = len(offsets) - 1
    at, counts = words.window_places(found.bounds, width)
    if len(at):
        shingles = words.stretches(hashes, at, at + width)
    else:
        shingles = np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(rows), counts)
    sizes = np.diff(found.bounds)
    few = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(few):
        whole = words.stretches(hashes, found.bounds[few], found.bounds[few + 1])
        shingles = np.concatenate([shingles, words.mixed(whole + sizes[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    if len(shingles):
        fresh = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])])
        shingles, owner = shingles[fresh], owner[fresh]
    return shingles, np.searchsorted(owner, np.arange(rows + 1))


def set_names(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        total = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(words.mixed(shingles ^ np.uint64(salt)), out=total[1:])
        out.append(words.mixed(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def bitmap_bits(size: int) -> int:
    return max(LEAST_BITS, 1 << int(max(size, 1) - 1).bit_length())


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(shingles)), np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No more members than this are in both sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    only_a, only_b = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    return min(n_a - only_a, n_b - only_b)


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that very many texts hold, sorted.

    Found from those that stand out in a task, so nearly complete; any set will do for right results. It has at
    most ``COMMON_SHARE`` times as many members as a text has shingles on average, however large the corpus.
    """

    def count(batches):
        held, size, rows = np.empty(COUNT_TOGETHER, np.uint64), 0, 0
        for whole in batches:
            for batch in blocks(whole, "_text", TEXT_BYTES):
                shingles, _ = shingle_sets(*buffers(batch.column("_text").fill_null("")), width)
                rows += batch.num_rows
                while len(shingles):
                    fits = min(len(shingles), COUNT_TOGETHER - size)
                    held[size : size + fits] = shingles[:fits]
                    size, shingles = size + fits, shingles[fits:]
                    if size == COUNT_TOGETHER:
                        yield told(held)
                        size = 0
        yield told(held[:size])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([rows], pa.int64())], names=["h", "n"])

    def told(hashes):
        hashes.sort()
        enough = hashes[COUNT_LEAST - 1 :] == hashes[: max(len(hashes) - COUNT_LEAST + 1, 0)]
        found = np.unique(hashes[: len(enough)][enough])
        counts = np.searchsorted(hashes, found, side="right") - np.searchsorted(hashes, found)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["h", "n"])

    counted = texts.select("_text").mapInArrow(freeing(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = stored(counted, "shingle-counts")
    rows = counted.filter("h IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(COMMON_LEAST, rows // COMMON_SHARE)
    found = counted.filter(F.col("h").isNotNull() & (F.col("n") >= least)).select("h").toArrow()
    discard(counted)
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def _signed(texts: DataFrame, width: int, alike: int, common) -> DataFrame:
    """The columns of ``texts`` but the text, then n, f1, f2 (the set's name), sig (its bitmap), and the set's early shingles:
    ``rare`` and ``often`` ones."""
    rest = [f for f in texts.schema if f.name != "_text"]
    schema = T.StructType(
        rest
        + [T.StructField("n", T.LongType())]
        + [T.StructField(f, T.LongType()) for f in ("f1", "f2")]
        + [T.StructField("sig", T.BinaryType())]
        + [T.StructField(f, T.ArrayType(T.LongType())) for f in ("rare", "often")]
    )

    def sign(batches):
        last = common.value
        for whole in batches:
            for batch in blocks(whole, "_text", TEXT_BYTES):
                shingles, at = shingle_sets(*buffers(batch.column("_text").fill_null("")), width)
                f1, f2 = set_names(shingles, at)
                sigs = [bitmap(shingles[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = np.diff(at)
                first = n + (-alike * n) // 100 + 1  # n - ceil(n * alike / 100) + 1
                first[n == 0] = 0
                often = np.zeros(len(shingles), bool)
                if len(last):
                    often = last[np.minimum(np.searchsorted(last, shingles), len(last) - 1)] == shingles
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((shingles, often, owner))
                chosen = order[spans(at[:-1], first)]
                lists = []
                for part in (chosen[~often[chosen]], chosen[often[chosen]]):
                    bounds = np.searchsorted(owner[part], np.arange(len(n) + 1))
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles[part].view(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name) for f in rest]
                    + [pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), pa.array(sigs, pa.binary()), *lists],
                    names=schema.names,
                )

    return texts.mapInArrow(freeing(sign), schema)


def _place(key: str):
    """A key's place in the filter: its word, and its bit there."""
    place = F.xxhash64(key)
    return F.shiftright(place.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6), f"CAST(xxhash64({key}) & 63 AS INT)"


def _bits(keys: DataFrame, key: str) -> DataFrame:
    """_word, _bits: a filter of fixed size that holds the keys, and others by chance."""
    word, bit = _place(key)
    return keys.groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits"))


def _with_hit(rows: DataFrame, bits: DataFrame, key: str) -> DataFrame:
    """Add _hit: whether the filter may hold the row's key."""
    word, bit = _place(key)
    found = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")  # at most 2^(FILTER_BITS - 6) rows
    hit = F.expr(f"coalesce(shiftright(_bits, {bit}) & 1, 0) = 1")
    return found.withColumn("_hit", hit).drop("_word", "_bits")


def _most(place, alike: int):
    """The size of the largest set that one of ``n`` can be alike with, if nothing before ``place`` is shared."""
    return F.expr(f"CAST((n - {place}) * {100 + alike}L DIV {alike} - n AS INT)").alias("most")


PLACED = np.dtype([("h", "<i8"), ("sid", "<i8"), ("n", "<i4"), ("place", "<i4")])  # a set in a tile, as it travels


def packed(rows: np.ndarray) -> bytes:
    """First bytes of all rows, then second ones and so on: what is equal or small stands together for the shuffle's compression."""
    return rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def _dealing(ranges: int, bits: int):
    """A function of batches of sets (sid, n, rare): for each of ``ranges`` ranges of tiles the rows of some ``DEALT_ROWS``, packed."""

    def told(held):
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["h"], kind="stable")]
        of = (rows["h"] * ranges) >> bits
        edges = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0, [True]]))
        data = [packed(rows[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(of[edges[:-1]], pa.int32()), pa.array(data, pa.binary())], names=["tiles", "rows"])

    def deal(batches):
        held, size = [], 0
        for whole in batches:
            step = max(1, DEALT_ROWS * whole.num_rows // max(1, len(whole.column("rare").flatten())))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                lists = batch.column("rare")
                names = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
                count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.empty(len(names), PLACED)
                rows["h"] = names
                for name in ("sid", "n"):
                    rows[name] = np.repeat(batch.column(name).to_numpy(zero_copy_only=False), count)
                rows["place"] = spans(np.zeros(len(count), np.int64), count)
                # Shingles of one set come in order; of those with the same name the first one tells its place.
                rows = rows[np.concatenate([[True], (np.diff(rows["h"]) != 0) | (rows["place"][1:] == 0)])[: len(rows)]]
                held.append(rows)
                size += len(rows)
                if size >= DEALT_ROWS:
                    yield told(held)
                    held, size = [], 0
        if size:
            yield told(held)

    return deal


def _undealt(alike: int):
    """A function of packed rows in order of their range: batches in order of tile (h, sid, n, most) without sets alone in one."""

    def batch(held):
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["h"], kind="stable")]
        same = np.diff(rows["h"]) == 0
        rows = rows[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        n = rows["n"].astype(np.int64)
        most = np.minimum((n - rows["place"]) * (100 + alike) // alike - n, np.iinfo(np.int32).max)
        columns = [np.ascontiguousarray(rows["h"]), np.ascontiguousarray(rows["sid"]), n, most]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "sid", "n", "most"])

    def undeal(batches):
        held, of = [], None
        for part in batches:
            for tiles, data in zip(part.column("tiles").to_pylist(), part.column("rows")):
                if held and tiles != of:
                    yield batch(held)
                    held = []
                of = tiles
                held.append(unpacked(data.as_buffer(), PLACED))
        if held:
            yield batch(held)

    return undeal


def _tiles(signed: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """h (the tile), sid, n, most, size, other: the sets that can meet another one with the same early shingle.

    Tiles are numbered in the order of the shingles. Of those below ``FEW`` sets there are the pairs sid, other in place of the sets.
    The first text of a set stands for it. Only texts of repeated sets, and those that a filter of fixed size takes for such, need a
    shuffle to tell. Sets go to ranges of tiles in packed rows, as nearly all are alone in a tile and go no further.
    """
    repeated = _bits(sets.filter("texts > 1"), "f1")
    early = _with_hit(signed.filter("n > 0").select("f1", F.col("t").alias("sid"), "n", "rare", "often"), repeated, "f1")
    firsts = _with_hit(sets.select("f1", "sid"), repeated, "f1").filter("_hit").select("sid")
    columns = ["sid", "n", "rare", "often"]
    several = stored(early.filter("_hit").select(*columns).join(firsts, "sid", "left_semi"), "several")
    placed = early.filter("NOT _hit").select(*columns).unionByName(several)
    ranges = RANGES * int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("sid", "n", "rare").mapInArrow(freeing(_dealing(ranges, TILE_BITS)), "tiles int, rows binary")
    dealt = dealt.repartition("tiles").sortWithinPartitions("tiles")
    undeal, meet = _undealt(alike), _meeting(FEW)
    rare = dealt.mapInArrow(freeing(lambda batches: meet(undeal(batches))), "h long, sid long, n int, most int, size long, other long")
    # Shingles of very many texts come after all others. Few sets have any among their early ones.
    name = F.shiftrightunsigned("h", 2).bitwiseOR(F.lit(1 << 62)).alias("h")
    often = placed.select(F.col("n").cast("int").alias("n"), "sid", F.size("rare").alias("rare"), F.posexplode("often").alias("place", "h"))
    often = often.select(name, "sid", "n", _most("(place + greatest(rare, 0))", alike))
    counts = often.groupBy("h").agg(F.greatest(F.count("*"), F.lit(FEW)).alias("size"), (F.count("*") > 1).alias("met")).filter("met")
    often = often.join(counts, "h").select("h", "sid", "n", "most", "size", F.lit(None).cast("long").alias("other"))
    tiles = stored(rare.unionByName(often), "tiles")
    discard(several)
    return tiles


def meeting(h: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which sets of a tile can meet another one of it; rows are in order of tile and size."""
    base = np.cumsum(np.concatenate([[0], np.diff(h) != 0])) << 35
    sizes, reach = base + n, base + np.maximum(most, 0)
    upto = np.searchsorted(sizes, reach, side="right")
    best = np.maximum.accumulate(reach)  # the greatest reach among the sets so far, and the one after it
    second = np.concatenate([[-1], np.maximum.accumulate(np.minimum(reach[1:], best[:-1]))])
    return (upto > 0) & (np.where(most >= n, second[upto - 1], best[upto - 1]) >= sizes)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
    return np.stack([a[fresh], b[fresh]], 1)


class PairsHeld:
    """Pairs of a task, without those that repeat among some ``PAIRS_HELD``."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether it is time to ``take`` them."""
        self.parts.append(np.stack([a, b], 1))
        self.size += len(a)
        if self.size <= PAIRS_HELD:
            return False
        self.parts = [distinct_pairs(*np.concatenate(self.parts).T)]
        self.size = len(self.parts[0])
        return self.size > PAIRS_HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = distinct_pairs(*np.concatenate([np.zeros((0, 2), np.int64), *self.parts]).T)
        self.parts, self.size = [], 0
        return pairs[:, 0], pairs[:, 1]


def _meeting(few: int):
    """A function of batches in order of tile (h, sid, n, most): rows of larger tiles, and pairs of those below ``few`` sets."""
    columns = ("h", "sid", "n", "most")

    def whole(batches):
        held: list = []
        for batch in batches:
            if batch.num_rows:
                rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
                last = int(np.searchsorted(rows[0] == rows[0][-1], True))
                if held and (last or held[-1][0][-1] != rows[0][0]):
                    yield map(np.concatenate, zip(*held, [r[:last] for r in rows]))
                    held = []
                elif last:
                    yield [r[:last] for r in rows]
                held.append([r[last:] for r in rows])
        if held:
            yield map(np.concatenate, zip(*held))

    def out(h, sid, n, most, size, other):
        values = [pa.array(h), pa.array(sid), pa.array(n, pa.int32()), pa.array(most, pa.int32()), pa.array(size), other]
        return pa.RecordBatch.from_arrays(values, names=["h", "sid", "n", "most", "size", "other"])

    def paired(a, b):
        none = np.zeros(len(a), np.int64)
        return out(none, a, none, none, none, pa.array(b))

    def meet(batches):
        pairs = PairsHeld()
        for rows in whole(batches):
            h, sid, n, most = rows
            order = np.lexsort((sid, n, h))
            order = order[meeting(h[order], n[order], most[order])]
            h, sid, n, most = h[order], sid[order], n[order], most[order]
            edges = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0, [True]])) if len(h) else np.zeros(1, int)
            sizes = np.repeat(np.diff(edges), np.diff(edges))
            for step in range(1, few - 1):
                a = np.flatnonzero((sizes[step:] < few) & (h[step:] == h[: max(len(h) - step, 0)]))
                b = a + step
                a, b = (side[(n[b] <= most[a]) & (n[a] <= most[b])] for side in (a, b))
                if pairs.add(sid[a], sid[b]):
                    yield paired(*pairs.take())
            many = sizes >= few
            if many.any():
                yield out(h[many], sid[many], n[many], most[many], sizes[many], pa.nulls(int(many.sum()), pa.int64()))
        yield paired(*pairs.take())

    return meet


def _large_tiles(tiles: DataFrame) -> DataFrame:
    """The tiles of ``FEW`` sets and more; of those with the same members the first one."""
    many = tiles.filter("other IS NULL").drop("other")
    lists = many.groupBy("h").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("sid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("x2")
    )
    kept = lists.groupBy("size", "x1", "x2").agg(F.min("h").alias("h")).select("h")
    return stored(many.join(kept, "h", "left_semi"), "large-tiles")


def _in_blocks(tiles: DataFrame, *more: str) -> DataFrame:
    """h, lo, hi (the block of a tile), part, sid, n and ``more``: a tile's sets, once for every other part."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = tiles.withColumn("part", F.pmod(F.xxhash64("sid"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    lo, hi = F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")
    return rows.select("h", lo, hi, "part", "sid", "n", *more)


TILE = ["h", "lo", "hi"]


def _whole_tiles(batches, names: tuple[str, ...]):
    """Columns of one tile after the other, whatever the batches; rows come in order of tile."""
    held: list = []

    def joined():
        return {c: np.concatenate([part[c] for part in held]) for c in names}

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        marks = np.stack([rows[c] for c in TILE], 1)
        edges = [0, *(np.flatnonzero((np.diff(marks, axis=0) != 0).any(1)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            part = {c: v[a:b] for c, v in rows.items()}
            if held and any(held[-1][c][0] != part[c][0] for c in TILE):
                yield joined()
                held = []
            held.append(part)
    if held:
        yield joined()


def _reach(n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of the following sets, in order of size, are no larger than the most of each."""
    return np.maximum(np.searchsorted(n, most, side="right") - np.arange(len(n)) - 1, 0)


def tile_pairs(n: np.ndarray, sigs: list[bytes], apart, alike: int, most: np.ndarray | None = None):
    """Places i, j and bound of the pairs of a tile (in order of size) that their bitmaps allow.

    ``apart(i, j)`` tells which pairs are wanted, ``most`` the largest partner of each set.
    """
    sizes = np.array([len(sig) for sig in sigs])
    widths = np.unique(sizes)
    folds: dict[int, np.ndarray] = {}
    for size in widths:  # wider bitmaps folded until they are as wide
        rows = np.zeros((len(n), size // 8), np.uint64)
        for width in widths[widths >= size]:
            own = np.flatnonzero(sizes == width)
            wide = np.frombuffer(b"".join(sigs[i] for i in own), np.uint64).reshape(len(own), width // size, size // 8)
            rows[own] = np.bitwise_or.reduce(wide, axis=1)
        folds[int(size)] = rows
    together = max(1, min(PAIRS_TOGETHER, TURN_BYTES // int(widths.max(initial=8))))
    most = n * 100 // alike if most is None else most
    count = _reach(n, most)
    total = np.cumsum(count)
    done = 0
    while done < len(n):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + together, side="right")))
        at = np.arange(done, upto)
        i, j = np.repeat(at, count[done:upto]), spans(at + 1, count[done:upto])
        done = upto
        ok = (n[i] <= most[j]) & apart(i, j)
        i, j = i[ok], j[ok]
        for size in np.unique(sizes[i]):
            turn = sizes[i] == size
            a, b, rows = i[turn], j[turn], folds[int(size)]
            x, y = rows[a], rows[b]
            only = [np.bitwise_count(one & ~two).sum(1, dtype=np.int64) for one, two in ((x, y), (y, x))]
            bound = np.minimum(n[a] - only[0], n[b] - only[1])
            good = bound >= need(n[a] + n[b], alike)
            yield a[good], b[good], bound[good]


def elsewhere(lead_a: np.ndarray, lead_b: np.ndarray, h: int) -> np.ndarray:
    """Which pairs another tile than that of ``h`` hands on; leads are padded with the greatest number."""
    top = np.iinfo(np.int64).max
    same = (lead_a[:, :, None] == lead_b[:, None, :]).any(2)
    least = np.where(same, lead_a, top).min(1)
    return (least != top) & (least != h)


def best_of(own: np.ndarray, other: np.ndarray, bound: np.ndarray, best: np.ndarray, partner: np.ndarray) -> None:
    """Set the best bound of each set of ``own`` and its partner (of several the least) where they beat those known."""
    order = np.lexsort((other, -bound, own))
    order = order[np.concatenate([[True], np.diff(own[order]) > 0])]
    own, other, bound = own[order], other[order], bound[order]
    better = (bound > best[own]) | ((bound == best[own]) & (other < partner[own]))
    best[own[better]], partner[own[better]] = bound[better], other[better]


def _pairs(large: DataFrame, sets: DataFrame, groups: DataFrame | None, alike: int) -> DataFrame:
    """a, b, h: distinct pairs (a < b) of sets of larger tiles to decide; ``groups`` (node, component) of the first round for the second one.

    In the first round also the sets (a, no b) of each tile (h) that have other pairs there than the one handed on.
    """
    if groups is None:
        many = large.withColumn("group", F.col("sid"))
    else:  # only tiles of several groups go on, before bitmaps join them
        many = large.join(groups.withColumnRenamed("node", "sid"), "sid", "left")
        many = many.withColumn("group", F.coalesce("component", "sid")).drop("component")
        mixed = many.groupBy("h").agg((F.min("group") != F.max("group")).alias("mixed")).filter("mixed").select("h")
        many = many.join(mixed, "h", "left_semi")
    many = _in_blocks(many.join(sets.select("sid", "sig", "lead"), "sid"), "most", "group", "sig", "lead")
    many = many.repartition(*TILE).sortWithinPartitions(*TILE, "n", "sid")
    first_round = groups is None

    def batch(a, b, h=None):
        sides = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, b, h)]
        return pa.RecordBatch.from_arrays(sides, names=["a", "b", "h"])

    def meet_many(batches):
        top = np.iinfo(np.int64).max
        pairs, later, waiting = PairsHeld(), [], 0
        for rows in _whole_tiles(batches, (*TILE, "part", "sid", "n", "most", "group", "sig", "lead")):
            group, part, sid = rows["group"], rows["part"], rows["sid"]
            lead = np.full((len(sid), LEAD), top, np.int64)
            for place, least in enumerate(rows["lead"]):
                lead[place, : len(least)] = least
            split = rows["lo"][0] != rows["hi"][0]

            def apart(i, j):
                return (group[i] != group[j]) & ((part[i] != part[j]) if split else True)

            best, partner, known = np.full(len(sid), -1), np.full(len(sid), top), np.zeros(len(sid), np.int64)
            n, most = rows["n"].astype(np.int64), rows["most"].astype(np.int64)
            for i, j, bound in tile_pairs(n, list(rows["sig"]), apart, alike, most):
                here = ~elsewhere(lead[i], lead[j], rows["h"][0])
                i, j, bound = i[here], j[here], bound[here]
                if not len(i):
                    continue
                if first_round:  # each set with its best one
                    best_of(np.concatenate([i, j]), np.concatenate([sid[j], sid[i]]), np.concatenate([bound, bound]), best, partner)
                    known += np.bincount(np.concatenate([i, j]), minlength=len(sid))
                elif pairs.add(sid[i], sid[j]):
                    yield batch(*pairs.take())
            tied = best >= 0
            if pairs.add(sid[tied], partner[tied]):
                yield batch(*pairs.take())
            more = sid[known > 1]  # a pair that neither side hands on is a second one for both
            later.append((more, np.full(len(more), rows["h"][0])))
            waiting += len(more)
            if waiting > PAIRS_HELD // 2:
                sides, later, waiting = zip(*later), [], 0
                yield later_ones(*sides)
        yield batch(*pairs.take())
        if later:
            yield later_ones(*zip(*later))

    def later_ones(sid, h):
        return batch(np.concatenate(sid), None, np.concatenate(h))

    return many.mapInArrow(freeing(meet_many), "a long, b long, h long").distinct()


def _bounded(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """Pairs whose bitmaps allow the overlap they need; the filter of fixed size keeps the bitmaps of most others in place."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    small = _with_hit(sets.select("sid", "n", "sig"), _bits(ends, "sid"), "sid").filter("_hit").drop("_hit")
    for side in ("a", "b"):
        own = small.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
        pairs = pairs.join(own, side)

    def bound(frames):
        for frame in frames:
            bounds = [overlap_bound(*row) for row in zip(frame.sig_a, frame.n_a, frame.sig_b, frame.n_b)]
            yield frame.loc[np.array(bounds, np.int64) >= need(frame.n_a + frame.n_b, alike), ["a", "b"]]

    return pairs.mapInPandas(freeing(bound), "a long, b long")


def _wanted(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts of ``keys`` (sid, k1, k2); a filter of fixed size spares most others the shuffle."""
    near = _with_hit(texts, _bits(keys, "k1"), "k1").filter("_hit")
    found = near.select("k1", "k2", "_text").join(keys, ["k1", "k2"]).groupBy("k1", "k2", "sid").agg(F.first("_text").alias("_text"))
    return found.select("sid", "_text")


def _links(pairs: DataFrame, texts: DataFrame, sets: DataFrame, width: int, alike: int) -> DataFrame:
    """The pairs that are alike, by their sorted shingle arrays."""
    kept = stored(pairs, "pairs")
    pairs, ends = kept, kept.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    found = stored(_wanted(texts, sets.join(ends, "sid").select("sid", "k1", "k2")), "pair-texts")
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("sid").alias(side), F.col("_text").alias(f"text_{side}")), side)

    def decide(batches):
        for whole in batches:
            for half in blocks(whole, "text_a", TEXT_BYTES):
                for batch in blocks(half, "text_b", TEXT_BYTES):
                    sides = [shingle_sets(*buffers(batch.column(f"text_{s}")), width) for s in ("a", "b")]
                    (x, x_at), (y, y_at) = sides
                    keep = []
                    for i in range(batch.num_rows):
                        one, two = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                        shared = len(np.intersect1d(one, two, assume_unique=True))
                        keep.append(100 * shared >= alike * (len(one) + len(two) - shared))
                    yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stored(pairs.select("a", "b", "text_a", "text_b").mapInArrow(freeing(decide), "a long, b long"), "links")
    discard(found)
    discard(kept)
    return links


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None, text: str = "text",
    width: int = WIDTH, alike: int = ALIKE,
) -> DataFrame:
    """Columns of ``keep`` (the id), then k1, k2 (the text's key), n_shingles, set_id, group_id and component_id: the least id
    of the group."""
    keep = [id_col] if keep is None else keep
    spark = docs.sparkSession
    texts = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        F.col(id_col).alias("_id"), *text_key(text), F.coalesce(text, F.lit("")).alias("_text"),
    )
    common = spark.sparkContext.broadcast(common_shingles(texts, width))
    signed = stored(_signed(texts, width, alike, common).withColumn("t", F.monotonically_increasing_id()), "set-names")
    one = F.min_by(F.struct("n", "sig", "k1", "k2"), "t")
    sets = signed.filter("n > 0").groupBy("f1", "f2")  # a set's number is that of its first text
    sets = sets.agg(F.min("t").alias("sid"), F.count("*").alias("texts"), F.min("_id").alias("least"), one.alias("one"))
    sets = stored(sets.select("f1", "f2", "sid", "texts", "least", "one.*"), "sets")
    members = stored(signed.drop("sig", "rare", "often"), "set-rows")
    tiles = _tiles(signed, sets, alike)
    discard(signed)
    large = _large_tiles(tiles)
    few = tiles.filter("other IS NOT NULL").select(F.col("sid").alias("a"), F.col("other").alias("b"))
    few = stored(few.distinct(), "few-pairs")
    discard(tiles)
    # The least tiles of each set, as far as they are not small; at most as many as its early shingles.
    leads = large.groupBy("sid").agg(F.array_sort(F.collect_set("h")).alias("tiles"))
    inside = _with_hit(sets, _bits(large, "sid"), "sid").filter("_hit")
    marked = stored(inside.join(leads, "sid").select("sid", "sig", F.slice("tiles", 1, LEAD).alias("lead")), "leads")
    first = stored(_pairs(large, marked, None, alike), "first-pairs")
    met = first.filter("b IS NOT NULL").select("a", "b")
    met = stored(_bounded(few, sets, alike).unionByName(met).distinct(), "met")
    links = _links(met, texts, sets, width, alike)
    discard(few)
    groups = stored(components(links), "first-groups")
    later = first.filter("b IS NULL").select("h", F.col("a").alias("sid"))
    second = _pairs(large.join(later, ["h", "sid"], "left_semi"), marked, groups, alike).select("a", "b")
    more = _links(second.join(met, ["a", "b"], "left_anti"), texts, sets, width, alike)
    for used in (large, marked, first, met):
        discard(used)
    # What the second round links are groups of the first one.
    roots = more
    for side in ("a", "b"):
        own = groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        roots = roots.join(own, side, "left").withColumn(side, F.coalesce(f"of_{side}", side)).drop(f"of_{side}")
    joined = components(roots.select("a", "b"))
    named = sets.select("f1", "f2", "sid", "least").join(groups.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("node", F.coalesce("component", "sid")).drop("component").join(joined, "node", "left")
    named = named.select("f1", "f2", "sid", "least", F.coalesce("component", "node").alias("group_id"))
    least = named.groupBy("group_id").agg(F.min("least").alias("component_id"))
    named = named.drop("least").join(least, "group_id")
    # An empty set is a group of its own: its row number stands for it.
    placed = members.join(named, ["f1", "f2"], "left")
    empty = F.col("n") == 0
    return placed.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "k1", "k2", F.col("n").alias("n_shingles"),
        F.when(empty, -F.col("t") - 1).otherwise(F.col("sid")).alias("set_id"),
        F.when(empty, -F.col("t") - 1).otherwise(F.col("group_id")).alias("group_id"),
        F.when(empty, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents without near copies: of each group the one with the least id (then text) stays, once.

    Documents without words are linked with nothing and all stay. Columns are those of ``docs``.
    """
    own = [F.xxhash64(id_col).alias("_k0"), *[key.alias(f"_{name}") for key, name in zip(text_key(text), ("k1", "k2"))]]
    keys = ["_k0", "_k1", "_k2"]
    groups = near_groups(docs, id_col, [id_col], text, **settings).filter("n_shingles > 0")
    line = F.struct(F.col(id_col).isNull(), F.col(id_col), "k1", "k2")
    first = groups.groupBy("group_id").agg(F.min(line).alias("first"))
    first = first.select(F.xxhash64(f"first.{id_col}").alias("_k0"), F.col("first.k1").alias("_k1"), F.col("first.k2").alias("_k2"))
    first = stored(first.distinct(), "kept-keys")
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = docs.filter(~wordless).select("*", *own).join(first, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*docs.columns).unionByName(docs.filter(wordless))
