"""Fingerprints of texts from their improbable byte windows, and how alike two fingerprints are.

1. *Rarity.* The entropy of every window of ``WINDOW`` bytes falls into one of ``BINS`` bins. How many windows of the
   whole corpus fall into each bin is counted first; windows of rare bins rank before those of common ones.
2. *Features.* Of each ``WINDOW`` neighbouring windows the first one of the best rank gains a point; windows with enough
   points are features. Windows of little entropy (runs of one sign) never are.
3. *Digest.* Features, in order of place, go into Bloom filters of ``FILTER_BITS`` bits by five parts of their hash;
   after ``FILTER_FEATURES`` features the next filter of the chain begins.
   Texts shorter than ``LEAST_BYTES``, and any with fewer than ``FEW`` windows as features, have a second chain whose
   features are all their stretches of ``SHORT`` bytes (or the whole text, if it is shorter).
4. *Likeness.* Two texts are compared by their second chains if both have one, else by their windows, which every text
   keeps, so a text and a part of it share features on whatever side of ``LEAST_BYTES`` they lie. Each filter of the shorter chain takes its best match of the longer one: common bits, less those expected by
   chance, as a share of the most there could be; matches are weighed by the bits of the filter.

``with_next`` also compares each text with the following one (descending id) and with an edited form that ends in the
following one's beginning. Texts are range-partitioned once; only the first and last text of a range meet the
neighbouring ranges, as a table of two rows for each range.

Defined results: null texts count as empty and have an empty fingerprint, alike to empty ones only (1.0, else 0.0); only
empty texts have an empty fingerprint; texts too short for a neighbourhood of windows (under 127 bytes) share nothing
with texts that have no second chain; equal texts have equal fingerprints; null
ids come last; equal ids go by text; the only text of a table follows itself.
"""

from __future__ import annotations

import base64
import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.llm import words
from pairloom.llm.common import text_key
from pairloom.llm.pieces import blocks, buffers, spans
from pairloom.session import written

WINDOW = 64
SHORT = 8
LEAST_BYTES = 8 * WINDOW  # below, windows alone are too few to tell a text from its edited form
FEW = 4
BINS = 1000
LEAST_BIN = 100
POINTS = 16
FILTER_BITS = 512
FILTER_FEATURES = 32
HASHES = 5
SEGMENT = 1 << 18  # bytes whose entropies are found together, so that arrays stay in the cache
BLOCK = 1 << 20


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of WINDOW bytes as a bin from 0 (one sign only) to BINS."""
    count = len(data) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.int16)
    out = np.empty(count, np.int16)
    for start in range(0, count, SEGMENT):
        stop = min(start + SEGMENT, count)
        out[start:stop] = _segment_bins(data[start : stop + WINDOW - 1])
    return out


def _segment_bins(data: np.ndarray) -> np.ndarray:
    """A window's sum of c log c changes by the sign that leaves and the one that enters."""
    size = len(data)
    terms = np.array([0] + [round(c * math.log2(c) * 65536) for c in range(1, WINDOW + 1)], np.int64)
    ahead, behind = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    for step in range(1, min(WINDOW, size)):
        same = (data[:-step] == data[step:]).view(np.uint8)
        ahead[:-step] += same
        behind[step:] += same
    total = np.empty(size - WINDOW + 1, np.int64)
    total[0] = terms[np.bincount(data[:WINDOW], minlength=256)].sum()
    leaves, enters = ahead[: size - WINDOW], behind[WINDOW:]
    fall, rise = terms[:-1] - terms[1:], terms[1:] - terms[:-1]
    total[1:] = total[0] + np.cumsum(fall[leaves] + rise[enters])
    whole = WINDOW * math.log2(WINDOW) * 65536
    return ((whole - total) * (BINS / whole) + 0.5).astype(np.int16)


def rarity(texts: DataFrame, text: str) -> list[int]:
    """Rank of each bin, from the windows of all texts: the rarest bin first, bins of little entropy last."""

    def count(batches):
        total = np.zeros(BINS + 1, np.int64)
        for whole in batches:
            for batch in blocks(whole, text, BLOCK):
                offsets, data = buffers(batch.column(text).fill_null(""))
                bins = entropy_bins(data)
                inside = np.diff(offsets) >= WINDOW
                marks = np.zeros(len(data) + 1, np.int64)
                np.add.at(marks, offsets[:-1][inside], 1)
                np.add.at(marks, offsets[1:][inside] - WINDOW + 1, -1)
                total += np.bincount(bins[np.cumsum(marks)[: len(bins)] > 0], minlength=BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS + 1), pa.int32()), pa.array(total)], names=["bin", "n"])

    counted = texts.select(text).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    counts = {row.bin: row.n for row in counted.collect()}  # one row for each bin
    order = sorted(range(BINS + 1), key=lambda b: (b < LEAST_BIN, counts.get(b, 0), b))
    ranks = [0] * (BINS + 1)
    for rank, b in enumerate(order):
        ranks[b] = rank
    return ranks


Hashed = tuple[np.ndarray, np.ndarray]  # owner and hash of features


def features(offsets: np.ndarray, data: np.ndarray, ranks: np.ndarray) -> tuple[Hashed, Hashed]:
    """Windows and stretches that are features of the texts, in order of place; each hash once for a text."""
    sizes = np.diff(offsets)
    signs = data.astype(np.uint64) + np.uint64(1)
    windows = _once(*_windows(offsets, data, ranks), signs)
    few = (sizes < LEAST_BYTES) | (np.bincount(windows[0], minlength=len(sizes)) < FEW)
    return windows, _once(*_stretches(offsets, np.flatnonzero(few & (sizes > 0))), signs)


def _stretches(offsets: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, owner and end of all stretches of SHORT bytes, or the whole text if it is shorter."""
    if not len(texts):
        return texts, texts, texts
    sizes = offsets[texts + 1] - offsets[texts]
    width = np.minimum(SHORT, sizes)
    counts = sizes - width + 1
    at = spans(offsets[texts], counts)
    return at, np.repeat(texts, counts), at + np.repeat(width, counts)


def _windows(offsets: np.ndarray, data: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, owner and end of the windows that win enough neighbourhoods of their text."""
    none = np.zeros(0, np.int64)
    bins = entropy_bins(data)
    size = len(bins)
    groups = np.diff(offsets) - 2 * WINDOW + 2  # groups of WINDOW windows that lie inside one text
    many = np.flatnonzero(groups > 0)
    if not len(many):
        return none, none, none
    key = ranks[bins].astype(np.int64) << 40 | np.arange(size)
    least, reach = key, 1
    while reach < WINDOW:
        step = min(reach, WINDOW - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    starts, counts = offsets[many], groups[many]
    won = least[spans(starts, counts)] & ((1 << 40) - 1)
    points = np.bincount(won, minlength=size)
    text = np.repeat(many, counts)
    enough = np.minimum(POINTS, groups[text])
    fresh = np.ones(len(won), bool)
    fresh[1:] = won[1:] != won[:-1]
    hit = fresh & (points[won] >= enough) & (bins[won] >= LEAST_BIN)
    return won[hit], text[hit], won[hit] + WINDOW


def _once(place: np.ndarray, owner: np.ndarray, ends: np.ndarray, signs: np.ndarray) -> Hashed:
    """Owner and hash of stretches in order of place, each hash once for a text."""
    if not len(place):
        return owner, np.zeros(0, np.uint64)
    hashes = words.stretches(signs, place, ends)
    order = np.lexsort((place, hashes, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    chosen = order[first]
    chosen = chosen[np.lexsort((place[chosen], owner[chosen]))]
    return owner[chosen], hashes[chosen]


class Fingerprint(NamedTuple):
    """Chains of filters, a row of bits for each filter."""

    windows: np.ndarray
    stretches: np.ndarray


def fingerprints(offsets: np.ndarray, data: np.ndarray, ranks: np.ndarray) -> list[Fingerprint]:
    rows = len(offsets) - 1
    windows, stretches = (_filters(*hashed, rows) for hashed in features(offsets, data, ranks))
    return [Fingerprint(*chains) for chains in zip(windows, stretches)]


def _filters(owner: np.ndarray, hashes: np.ndarray, rows: int) -> list[np.ndarray]:
    """Chain of filters of each text."""
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    filters = -(-np.diff(bounds) // FILTER_FEATURES)
    first = np.concatenate([[0], np.cumsum(filters)])
    which = first[owner] + (np.arange(len(owner)) - bounds[owner]) // FILTER_FEATURES
    bits = np.zeros((int(first[-1]), FILTER_BITS), np.uint8)
    width = FILTER_BITS.bit_length() - 1
    for part in range(HASHES):
        index = (hashes >> np.uint64(part * width)) & np.uint64(FILTER_BITS - 1)
        bits[which, index.astype(np.int64)] = 1
    return [bits[a:b] for a, b in zip(first[:-1], first[1:])]


def as_text(found: Fingerprint) -> str:
    """Both chains in base64, the second one after a dot; without a dot there is no second one."""
    windows, stretches = (base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode() for chain in found)
    return f"{windows}.{stretches}" if stretches else windows


def from_text(digest: str) -> Fingerprint:
    windows, _, stretches = digest.partition(".")
    chains = [np.frombuffer(base64.b64decode(part), np.uint8).reshape(-1, FILTER_BITS // 8) for part in (windows, stretches)]
    return Fingerprint(*[np.unpackbits(chain, axis=1) for chain in chains])


def likeness(one: Fingerprint, two: Fingerprint) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if len(one.stretches) and len(two.stretches):
        return _likeness(one.stretches, two.stretches)
    if not any(map(len, one)) and not any(map(len, two)):
        return 1.0
    return _likeness(one.windows, two.windows)


def _likeness(one: np.ndarray, two: np.ndarray) -> float:
    if not len(one) or not len(two):
        return 0.0
    if one.shape == two.shape and (one == two).all():
        return 1.0
    short, long = (one, two) if len(one) <= len(two) else (two, one)
    a, b = short.astype(np.float32), long.astype(np.float32)
    own, other = a.sum(1), b.sum(1)
    chance = own[:, None] * other[None, :] / FILTER_BITS
    most = np.minimum(own[:, None], other[None, :])
    found = np.clip((a @ b.T - chance) / np.maximum(most - chance, 1e-6), 0.0, 1.0)
    return float((found.max(1) * own).sum() / own.sum())


def edited(text: str, following: str) -> str:
    """The last third of the signs replaced by the beginning of the following text."""
    part = len(text) // 3
    return text[: len(text) - part] + following[:part]


FIELDS = [
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
]


def _chains(texts: list[str], ranks: np.ndarray) -> list[Fingerprint]:
    data = [text.encode() for text in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return fingerprints(offsets, np.frombuffer(b"".join(data), np.uint8), ranks)


def _compared(text: str, chain: Fingerprint, changed: str, changed_chain: Fingerprint, after: Fingerprint) -> tuple:
    sha = hashlib.sha256(changed.encode()).hexdigest()
    return len(text), sha, as_text(chain), as_text(changed_chain), likeness(chain, changed_chain), likeness(chain, after)


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each text."""
    texts = docs.select(F.col(id_col).alias("_id"), *text_key(text), F.coalesce(text, F.lit("")).alias("_text"))
    ranks = rarity(texts, "_text")
    order = [F.col("_id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    keys = [f for f in texts.schema if f.name != "_text"]
    edge = [T.StructField("kind", T.IntegerType()), T.StructField("_text", T.StringType())]
    schema = T.StructType([*keys, *FIELDS, *edge])
    none = [None] * len(FIELDS)

    def compare(batches):
        rank = np.array(ranks, np.int64)
        held = None  # the last text, which waits for the following one
        for whole in batches:
            for batch in blocks(whole, "_text", BLOCK):
                own = [list(x) for x in zip(*[batch.column(f.name).to_pylist() for f in keys])]
                read = batch.column("_text").to_pylist()
                before = [] if held is None else [held]
                changed = [edited(a, b) for a, b in zip([h[1] for h in before] + read, read[0 if before else 1 :])]
                chains = _chains(read + changed, rank)
                line = before + list(zip(own, read, chains))
                rows = [[*own[0], *none, 1, read[0]]] if held is None else []
                for i, new in enumerate(changed):
                    key, here, chain = line[i]
                    rows.append([*key, *_compared(here, chain, new, chains[len(read) + i], line[i + 1][2]), 0, None])
                held = line[-1]
                yield _batch(rows, schema)
        if held is not None:
            yield _batch([[*held[0], *none, 2, held[1]]], schema)

    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(compare, schema), "digests")
    inner = found.filter("kind = 0").select("_id", *[f.name for f in FIELDS])
    # Two rows for each range: its first text, which the range before waits for, and its last one.
    line = Window.orderBy(*order, "kind")
    edges = found.filter("kind > 0").select("_id", "k1", "k2", "kind", "_text")
    start = F.first("_text").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = F.coalesce(F.lead("_text").over(line), start)
    last = edges.withColumn("_after", after).filter("kind = 2").select("_id", "_text", "_after")
    final = T.StructType([T.StructField("_id", texts.schema["_id"].dataType), *FIELDS])

    def finish(batches):
        rank = np.array(ranks, np.int64)
        for batch in batches:
            rows = []
            for key, here, following in zip(*[batch.column(c).to_pylist() for c in ("_id", "_text", "_after")]):
                new = edited(here, following)
                chain, changed_chain, next_chain = _chains([here, new, following], rank)
                rows.append([key, *_compared(here, chain, new, changed_chain, next_chain)])
            yield _batch(rows, final)

    return inner.unionByName(last.mapInArrow(finish, final)).withColumnRenamed("_id", id_col)


ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[list], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(column, ARROW.get(f.dataType.simpleString())) for column, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)
