"""Remove passages that occur anywhere else in the corpus, by factoring each text against all the others.

A text is factored relative to the rest of the corpus: a factor is a maximal stretch of words all of whose windows of
``width`` words start somewhere else too. Factors cannot start or end unseen, as every window that touches a
shared stretch is looked up by itself, those over factor boundaries included.

1. *Index.* Of the ``width - gram + 1`` word grams in a window, the one with the least hash is its anchor; equal
   windows have equal anchors, so a text is indexed by one gram in about ten. All texts are the reference.
2. *Factors.* Windows whose anchor stands at one place only cannot occur elsewhere. All others are looked up by
   the hash of their whole content, and neighbouring hits join to factors, kept as spans of words.
3. *Removal.* Words under a factor go.

What stands twice in a block of texts is settled in the task that reads it, and one row informs the others. So a hash
that a third of all texts share sends one row for each block, not one for each text. Texts travel compressed.

Defined results: null texts have no words; repeated rows count as occurrences of their own, so all their windows
go; a text shorter than ``width`` words stays whole; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.llm import words
from pairloom.llm.common import freeing, text_key
from pairloom.llm.pieces import blocks, buffers
from pairloom.session import written

WIDTH = 35
GRAM = 16
KEYS = ["k1", "k2"]


def settle(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes stand at least twice here, and one place of each of those."""
    _, first, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return counts[which] > 1, first[counts > 1]


def anchors(found: words.Words, hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """First word of each window, the place of its anchor, windows of each text; and all gram hashes."""
    grams = words.windows(hashes, gram)
    at, counts = words.window_places(found.bounds, width)
    if not len(at):
        return at, at, counts, grams
    return at, words.sliding_least(grams, width - gram + 1)[at], counts, grams


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """Lists of ``values`` for each of ``rows`` rows; ``owner`` does not fall."""
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def _index(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """k1, k2 and the anchors of each text: settled here, asked for elsewhere, told to others."""

    def index(batches):
        for whole in batches:
            for batch in blocks(whole, "_text", words.BLOCK):
                found = words.Words(*buffers(batch.column("_text").fill_null("")))
                _, place, counts, grams = anchors(found, found.hashes(), width, gram)
                place = np.unique(place)
                owner = np.searchsorted(found.bounds, place, side="right") - 1
                hashes = grams[place] if len(place) else np.zeros(0, np.uint64)
                sure, told = settle(hashes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1"), batch.column("k2")]
                    + [_lists(hashes[m], owner[m], batch.num_rows) for m in (sure, ~sure)]
                    + [_lists(hashes[np.sort(told)], owner[np.sort(told)], batch.num_rows)],
                    names=[*KEYS, "sure", "ask", "tell"],
                )

    return texts.mapInArrow(freeing(index), "k1 long, k2 long, sure array<long>, ask array<long>, tell array<long>")


def _suspects(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """t (a number), k1, k2, anchors: of each distinct text, the anchors that stand somewhere else too."""
    index = written(_index(texts, width, gram).withColumn("t", F.monotonically_increasing_id()), "repeat-index")
    asked = index.select("t", F.explode("ask").alias("h"), F.lit(1).alias("n")).unionByName(
        index.select(F.lit(None).cast("long").alias("t"), F.explode("tell").alias("h"), F.lit(2).alias("n"))
    )
    times = F.sum("n").over(Window.partitionBy("h"))
    found = asked.withColumn("times", times).filter("times > 1 AND t IS NOT NULL")
    found = found.groupBy("t").agg(F.collect_list("h").alias("found"))
    none = F.array().cast("array<long>")
    joined = index.select("t", *KEYS, "sure").join(found, "t", "left")
    joined = joined.withColumn("anchors", F.concat("sure", F.coalesce("found", none))).filter("size(anchors) > 0")
    distinct = joined.groupBy(*KEYS).agg(F.min_by(F.struct("t", "anchors"), "t").alias("one"))
    return written(distinct.select("one.t", *KEYS, "one.anchors"), "repeat-suspects")


def _packed(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns as _k0 ..., key and compressed text."""
    chosen = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *text_key(text), F.coalesce(text, F.lit("")).alias("_text")
    )
    schema = T.StructType([f for f in chosen.schema if f.name != "_text"] + [T.StructField("_z", T.BinaryType())])

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            packed = [packer.compress(value.as_buffer()) for value in batch.column("_text")]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=schema.names)

    return chosen.mapInArrow(freeing(pack), schema)


def _hits(docs: DataFrame, suspects: DataFrame, text: str, width: int, gram: int) -> DataFrame:
    """t and spans: the windows of each suspect text that start somewhere else too."""
    schema = "h long, n int, t long, start int, stop int"

    def look(batches):
        unpacker = zstandard.ZstdDecompressor()
        for whole in batches:
            sizes = np.cumsum([zstandard.frame_content_size(z.as_buffer()) for z in whole.column("_z")])
            cuts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1] + words.BLOCK, words.BLOCK))) if len(sizes) else []
            edges = sorted({0, whole.num_rows, *[int(c) for c in cuts if c < whole.num_rows]})
            for a, b in zip(edges[:-1], edges[1:]):
                yield from block(whole.slice(a, b - a), unpacker)

    def block(batch, unpacker):
        texts = [unpacker.decompress(z.as_buffer()) for z in batch.column("_z")]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        found = words.Words(offsets, np.frombuffer(b"".join(texts), np.uint8))
        hashes = found.hashes()
        at, place, counts, grams = anchors(found, hashes, width, gram)
        if not len(at):
            return
        owner = np.repeat(np.arange(len(texts)), counts)
        listed = batch.column("anchors")
        marks = listed.flatten().to_numpy().view(np.uint64)
        mark_owner = np.repeat(np.arange(len(texts)), np.diff(listed.offsets.to_numpy()))
        known = np.unique(words.mixed(marks + mark_owner.astype(np.uint64) * words.BASE))
        mine = words.mixed(grams[place] + owner.astype(np.uint64) * words.BASE)
        near = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
        at, owner = at[near], owner[near]
        content = words.stretches(hashes, at, at + width)
        sure, told = settle(content)
        t = batch.column("t").to_numpy()[owner]
        start = (at - found.bounds[owner]).astype(np.int32)
        # Neighbouring settled windows of a text go on as one span.
        keep = np.flatnonzero(sure)
        cut = np.flatnonzero((np.diff(at[keep]) > 1) | (np.diff(owner[keep]) > 0)) + 1
        first, last = np.concatenate([[0], cut]).astype(int), np.concatenate([cut - 1, [len(keep) - 1]]).astype(int)
        if len(keep):
            a, z = keep[first], keep[last]
            yield rows(t[a].copy(), 2, t[a], start[a], start[z] + width)
            yield rows(content[told].view(np.int64), 2, None, None, None)
        ask = ~sure
        yield rows(content[ask].view(np.int64), 1, t[ask], start[ask], start[ask] + width)

    def rows(h, n, t, start, stop):
        none = [pa.nulls(len(h), pa.int64()), *[pa.nulls(len(h), pa.int32())] * 2]
        own = none if t is None else [pa.array(t, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())]
        counts = pa.array(np.full(len(h), n, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), counts, *own], names=["h", "n", "t", "start", "stop"])

    joined = _packed(docs, [], text).join(suspects, KEYS).select("_z", "t", "anchors")
    asked = joined.mapInArrow(freeing(look), schema)
    times = F.sum("n").over(Window.partitionBy("h"))
    found = asked.withColumn("times", times).filter("times > 1 AND t IS NOT NULL")
    return found.groupBy("t").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _removed(docs: DataFrame, keep: list[str], text: str, width: int, gram: int, tidy: bool) -> DataFrame:
    """_k0 ... (the columns of ``keep``), n_words, spans, n_removed, kept.

    ``tidy`` joins the words of every text by one space; without it, texts that lose nothing stay as they are.
    """
    texts = docs.select(*text_key(text), F.col(text).alias("_text"))
    suspects = _suspects(texts, width, gram)
    hits = _hits(docs, suspects, text, width, gram)
    spans = hits.join(suspects.select("t", *KEYS), "t").select(*KEYS, "spans")
    packed = _packed(docs, keep, text)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType(
        [T.StructField(f"_k{i}", packed.schema[f"_k{i}"].dataType) for i in range(len(keep))]
        + [T.StructField("n_words", T.LongType()), T.StructField("spans", span)]
        + [T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    )

    def remove(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, out_spans, removed, kept = [], [], [], []
            for z, listed in zip(batch.column("_z"), batch.column("spans").to_pylist()):
                whole = unpacker.decompress(z.as_buffer())
                parts = whole.split()  # bytes.split() parts at space and 9 to 13
                gone = merged([(s["start"], s["stop"]) for s in listed or []])
                n_words.append(len(parts))
                out_spans.append([{"start": a, "stop": b} for a, b in gone])
                removed.append(sum(b - a for a, b in gone))
                for a, b in reversed(gone):
                    del parts[a:b]
                kept.append(b" ".join(parts) if gone or tidy else whole)
            columns = [batch.column(f"_k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(n_words, pa.int64()),
                    pa.array(out_spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=schema.names,
            )

    return packed.join(spans, KEYS, "left").mapInArrow(freeing(remove), schema)


def remove_repeats(
    docs: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """Columns of ``keep``, n_words, spans (removed words), n_removed, kept (the words left, joined by one space)."""
    found = _removed(docs, keep, text, width, gram, tidy=True)
    rest = ["n_words", "spans", "n_removed", "kept"]
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *rest)


def without_repeats(
    docs: DataFrame, text: str = "text", size: str | None = None, width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """The documents without repeated passages, columns unchanged; texts that lose nothing stay as they are.

    ``size`` names the column that holds the text's length; it follows a changed text.
    """
    marked = docs.withColumn("_no_text", F.col(text).isNull())
    keep = [c for c in marked.columns if c != text]
    found = _removed(marked, keep, text, width, gram, tidy=False)
    place = {c: F.col(f"_k{i}") for i, c in enumerate(keep)}
    place[text] = F.when(place["_no_text"], F.lit(None)).otherwise(F.col("kept"))
    if size in place:
        changed = F.length("kept").cast(docs.schema[size].dataType)
        place[size] = F.when(F.col("n_removed") > 0, changed).otherwise(place[size])
    return found.select(*[place[c].alias(c) for c in docs.columns])
