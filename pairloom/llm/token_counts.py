"""Count the tokens of whole documents, huge ones in overlapping chunks that are spliced where both agree.

Documents up to ``chunk_chars`` are counted where they lie: distinct pieces (see ``pieces``) are encoded once for a
task. A longer document becomes windows that overlap their successor; windows are spread over the cluster and
encoded by themselves, with the places and token counts of the proven boundaries in their overlaps. Two neighbours are
spliced at the first place that both have, so that neither side depends on what its window left out. Where a pair of
windows finds no such place, the overlap is widened to the whole of the neighbour: runs of up to ``WIDER`` such windows
go through again as one, at last the whole text. The windows of a round hold the text once, besides the overlaps, so a
text without boundaries costs its size for each of a few rounds (the logarithm of its windows to the base ``WIDER``).

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are kept one by one, repeated ids included;
equal huge texts are counted once and joined back; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import text_key
from pairloom.llm.pieces import PieceEncoder, blocks, buffers, strings, sums_between
from pairloom.session import written

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
WIDER = 16  # windows that become one where they find no boundary

WINDOWS = "k1 long, k2 long, place int, start long, overlap_end long, next_start long, part string"
PLACES = ("start", "overlap_end", "next_start")
COUNTS = "k1 long, k2 long, place int, start long, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def windows(size: int, starts: list[int], overlap: int) -> list[tuple[int, int, int]]:
    """(start, end of the overlap with the window before, end) of the windows of a text of ``size`` signs."""
    starts = list(starts)
    ends = [min(start + overlap, size) for start in starts[1:]] + [size]
    while len(starts) > 1 and ends[-2] == size:  # the rest lies in the overlap
        starts.pop(), ends.pop()
    return [(s, ends[i - 1] if i else 0, e) for i, (s, e) in enumerate(zip(starts, ends))]


def splice(parts: pd.DataFrame) -> tuple[int | None, list[int]]:
    """Tokens of a text from the counts of its windows; where neighbours share no boundary, None and wider windows' starts."""
    parts = parts.drop_duplicates("place").sort_values("place")
    total, begin, joined, failed = 0, 0, 1, False
    rows = list(parts.itertuples(index=False))
    starts = [int(rows[0].start)]
    for row, after in zip(rows, rows[1:]):
        ours = dict(zip(row.right_at, row.right_n))
        common = [(ours[p], n) for p, n in zip(after.left_at, after.left_n) if p in ours and ours[p] >= begin]
        failed = failed or not common
        if common:
            total += common[0][0] - begin
        begin = common[0][1] if common else 0
        if common or joined == WIDER:
            starts.append(int(after.start))
            joined = 1
        else:
            joined += 1
    return (None, starts) if failed else (total + int(rows[-1].n) - begin, [])


def _long_counts(texts: DataFrame, spec: str, overlap: int) -> DataFrame:
    """k1, k2, n_tokens (null where windows could not be aligned), starts of wider windows of distinct long texts."""

    def cut(batches):
        for batch in (part for whole in batches for part in blocks(whole, "_text")):
            for row in batch.to_pylist():
                found = windows(len(row["_text"]), row["starts"], overlap)
                for place, (start, overlap_end, end) in enumerate(found):
                    next_start = found[place + 1][0] if place + 1 < len(found) else end
                    columns = [row["k1"], row["k2"], place, start, overlap_end, next_start, row["_text"][start:end]]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, columns))], schema=arrow)

    names = [part.split()[0] for part in WINDOWS.split(", ")]
    arrow = pa.schema(
        [(n, pa.string() if n == "part" else pa.int32() if n == "place" else pa.int64()) for n in names]
    )

    def count(batches):
        encoder = PieceEncoder(spec)
        for whole in batches:
            for batch in blocks(whole, "part"):
                offsets, data = buffers(batch.column("part"))
                bounds = encoder.boundaries(offsets, data)
                which = encoder.look_up(strings(bounds, data))
                tokens = np.concatenate([[0], np.cumsum(encoder.lengths[which])])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                edges = np.searchsorted(bounds, offsets)
                sides: dict[str, list] = {name: [] for name in ("left_at", "left_n", "right_at", "right_n")}
                for i, (start, low_end, high) in enumerate(zip(*[batch.column(c).to_pylist() for c in PLACES])):
                    # Bounds inside the window; its own ends are no proven boundaries.
                    inner = slice(edges[i] + 1, edges[i + 1])
                    at = start + chars[bounds[inner]] - chars[offsets[i]]
                    n = tokens[inner] - tokens[edges[i]]
                    for side, near in (("left", at < low_end), ("right", at > high)):
                        sides[f"{side}_at"].append(at[near])
                        sides[f"{side}_n"].append(n[near])
                columns = [batch.column(c) for c in ("k1", "k2", "place", "start")]
                total = pa.array(tokens[edges[1:]] - tokens[edges[:-1]], pa.int64())
                listed = [pa.array(values, pa.list_(pa.int64())) for values in sides.values()]
                yield pa.RecordBatch.from_arrays([*columns, total, *listed], names=[c.split()[0] for c in COUNTS.split(", ")])

    def together(key, frame):
        total, starts = splice(frame)
        return pd.DataFrame({"k1": [key[0]], "k2": [key[1]], "n_tokens": pd.array([total], "Int64"), "starts": [starts]})

    parts = texts.mapInArrow(cut, WINDOWS).repartition("k1", "k2", "place")
    counted = parts.mapInArrow(count, COUNTS)
    return counted.groupBy("k1", "k2").applyInPandas(together, "k1 long, k2 long, n_tokens long, starts array<long>")


def count_tokens(
    docs: DataFrame,
    spec: str,
    keep: list[str],
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """Columns of ``keep``, n_bytes, n_tokens for each document."""
    chosen = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = T.StructType(
        [T.StructField(f"_k{i}", chosen.schema[i].dataType) for i in range(len(keep))]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def count(batches):
        encoder = PieceEncoder(spec)
        for whole in batches:
            for batch in blocks(whole, "_text"):
                offsets, data = buffers(batch.column("_text").fill_null(""))
                bounds = encoder.boundaries(offsets, data)
                at = encoder.look_up(strings(bounds, data))
                tokens = sums_between(encoder.lengths[at], np.searchsorted(bounds, offsets))
                columns = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64())], names=schema.names
                )

    size = F.coalesce(F.length("_text"), F.lit(0))
    short = chosen.filter(size <= chunk_chars).mapInArrow(count, schema)
    long = chosen.filter(size > chunk_chars).withColumns(dict(zip(("k1", "k2"), text_key("_text"))))
    distinct = long.groupBy("k1", "k2").agg(F.first("_text").alias("_text"))
    starts = F.sequence(F.lit(0).cast("long"), F.length("_text").cast("long") - 1, F.lit(chunk_chars).cast("long"))
    pending, rounds = distinct.withColumn("starts", starts), []
    while True:
        counted = written(_long_counts(pending, spec, overlap_chars), "token-counts")
        rounds.append(counted.filter("n_tokens IS NOT NULL").drop("starts"))
        left = counted.filter("n_tokens IS NULL").select("k1", "k2", "starts")
        if left.isEmpty():
            break
        pending = distinct.join(left, ["k1", "k2"])
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    narrow = long.select(*schema.names[:-2], "k1", "k2", F.octet_length("_text").cast("long").alias("n_bytes"))
    joined = narrow.join(found, ["k1", "k2"], "left").select(*schema.names)
    return short.unionByName(joined).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens")
