"""Find stretches of words that repeat with a period, and keep one period of each.

A run of period q is a stretch of words that equal those q places later, at least ``LEAST_PERIODS`` periods and
``LEAST_WORDS`` words long, that no neighbour extends; q is its smallest period. Seeds and extensions along diagonals find
them, a diagonal being the places i where word i equals word i + q for one lag q:

1. *Index.* Lags are taken in bands from q to 2q. A run of a lag in the band overlaps itself, moved by its lag, in so many
   words at least: the k-grams of just this length are indexed for each text, by sorting their hashes.
2. *Pairs.* Occurrences of a k-gram that follow each other at a distance inside the band are seeds. Two that are further apart
   need no pair: k is no less than the lags, so a k-gram that also stood in between would give the run a smaller period. A
   k-gram that stands m times thus gives m - 1 pairs, however hot.
3. *Extension.* Seeds are met by lag and place. A table of the furthest place covered on each lag drops the seeds that lie
   inside what an earlier one was extended to; the others are extended as far as the diagonal goes on, which the next seeds
   tell word by word. An extension that is long enough is a run.

A text costs a sort of its k-grams for each band, and there are no more bands than doublings of its length.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; every row is judged by itself, so
repeated rows and null ids give the same again; extra columns are left out unless named in ``keep``. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm import words
from pairloom.llm.pieces import blocks, buffers, spans, strings

LEAST_WORDS = 6
LEAST_PERIODS = 4  # at least 3: the overlap must hold a k-gram as long as the greatest lag of its band

RUNS = "array<struct<start:long,length:long,period:long>>"


def least_overlap(lag: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> int:
    """Words of a run of this period that its copy, moved by the period, covers at least."""
    return max(least_words - lag, (least_periods - 1) * lag)


def bands(longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS):
    """First lag, last lag and k-gram length of every band that a text of ``longest`` words can have runs in."""
    first = 1
    while first * least_periods <= longest:
        last = 1 if first == 1 else 2 * (first - 1)
        yield first, last, min(least_overlap(q, least_words, least_periods) for q in range(first, min(last, first + least_words) + 1))
        first = last + 1


def seed_pairs(hashes: np.ndarray, bounds: np.ndarray, first: int, last: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and lag of the occurrences of a k-gram whose next one, in the same text, lies a lag of the band further."""
    at, counts = words.window_places(bounds, k)
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(1, len(bounds), dtype=np.uint64), counts)
    grams = words.mixed(words.stretches(hashes, at, at + k) + owner * words.BASE)
    order = np.argsort(grams, kind="stable")
    grams, at = grams[order], at[order]
    lag = at[1:] - at[:-1]
    hit = (grams[1:] == grams[:-1]) & (lag >= first) & (lag <= last)
    return at[:-1][hit], lag[hit]


def extended(place: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and period of the stretches that seeds are extended to."""
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    if not len(place):
        return place, place, place
    covered = place[:-1] + 1  # the furthest place that the extension so far has reached on this lag
    fresh = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (place[1:] > covered)]))
    furthest = np.append(fresh[1:], len(place)) - 1
    return place[fresh], place[furthest] + k + lag[fresh], lag[fresh]


def find_runs(
    hashes: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of texts that lie one after the other, by start, then period."""
    found = [(np.zeros(0, np.int64),) * 3]
    for first, last, k in bands(int(np.diff(bounds).max(initial=0)), least_words, least_periods):
        start, end, lag = extended(*seed_pairs(hashes, bounds, first, last, k), k)
        long = end - start >= np.maximum(least_words, least_periods * lag)
        found.append((start[long], end[long], lag[long]))
    start, end, lag = map(np.concatenate, zip(*found))
    order = np.lexsort((lag, start))
    return start[order], end[order], lag[order]


def repeated_words(count: int, start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Which of ``count`` words a run contains after its first period."""
    depth = np.zeros(count + 1, np.int64)
    np.add.at(depth, start + lag, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0


def joined_words(found: words.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    at = np.flatnonzero(kept)
    bounds = np.searchsorted(at, found.bounds)
    sizes = found.ends[at] - found.starts[at] + 1
    ends = bounds[1:][np.diff(bounds) > 0]
    sizes[ends - 1] -= 1  # no space after a text's last word
    data = np.append(found.data, np.uint8(32))[spans(found.starts[at], sizes)]
    total = np.concatenate([[0], np.cumsum(sizes)])
    gap = np.ones(len(at), bool)
    gap[ends - 1] = False
    data[total[1:][gap] - 1] = 32
    return strings(total[bounds], data)


def collapse_runs(
    docs: DataFrame, keep: list[str], text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """Columns of ``keep``, then n_words, runs (start, length and period in words, by start) and collapsed: the text of the
    words that no run repeats."""
    if least_periods < 3:
        raise ValueError("a run has three periods at least")
    chosen = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(text, F.lit("")).alias("_text"))
    rest = [f for f in chosen.schema if f.name != "_text"]
    schema = T.StructType([*rest, *T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed string").fields])
    names = schema.names

    def work(batches):
        for whole in batches:
            for batch in blocks(whole, "_text", words.BLOCK):
                found = words.Words(*buffers(batch.column("_text")))
                start, end, lag = find_runs(found.hashes(), found.bounds, least_words, least_periods)
                owner = np.searchsorted(found.bounds, start, side="right") - 1
                runs = pa.StructArray.from_arrays(
                    [pa.array(column) for column in (start - found.bounds[owner], end - start, lag)], ["start", "length", "period"]
                )
                at = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
                collapsed = joined_words(found, ~repeated_words(len(found.starts), start, end, lag))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name) for f in rest]
                    + [pa.array(np.diff(found.bounds)), pa.ListArray.from_arrays(pa.array(at), runs), collapsed],
                    names=names,
                )

    return chosen.mapInArrow(work, schema).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})
