"""Vocabulary, token ids, padding and the token budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pairloom.functions import arrays, text
from pairloom.operators.positions import numbered
from pairloom.session import written

# Ids of the special tokens; vocabulary ids follow.
PAD, CLS, SEP_ID, UNK = 0, 1, 2, 3
FIRST_ID = 4
LOOKUP_BYTES = 64 << 20  # of a vocabulary that goes along with the tasks
IDS_TOGETHER = 4096  # ids that are looked up together or not


def build_vocabulary(texts: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """Tokens with their ids, the most frequent first: all of them, or the first ``size``.

    Counts are combined before the shuffle; places come from ranges of the order, not from one task. The separator has
    an id of its own and takes no place.
    """
    counts = texts.select(F.explode(text.tokens(F.col(column))).alias("token")).groupBy("token").count()
    placed = numbered(counts.filter(F.col("token") != text.SEP_TOKEN), [F.desc("count"), F.col("token")], "tokens")
    chosen = placed if size is None else placed.filter(F.col("_index") < size)
    return chosen.select("token", (F.col("_index") + FIRST_ID).cast("int").alias("token_id"))


def encode(
    texts: DataFrame,
    vocabulary: DataFrame,
    id_col: str,
    column: str,
    max_len: int | None = None,
    lookup_bytes: int = LOOKUP_BYTES,
) -> DataFrame:
    """Token ids between the two special ids, at most ``max_len`` of them if that is given.

    While the vocabulary takes at most ``lookup_bytes``, it goes along with the tasks, and the tokens of a batch of texts
    are looked up where they lie. Of a larger one the most frequent tokens go along, as many as fit, and only what else a
    text holds is joined by token, once for each text. Texts are put together by row, not by id, so repeated ids stay apart.
    """
    words_of = text.tokens(F.col(column))
    kept = words_of if max_len is None else F.slice(words_of, 1, max_len - 2)
    placed = texts.select(id_col, kept.alias("kept"))
    bound = first_rare(vocabulary, lookup_bytes)
    if bound is None:
        listed = _looked_up(placed, vocabulary, id_col)
    else:
        listed = _joined(placed, vocabulary, id_col, bound)
    return listed.select(id_col, F.concat(F.array(F.lit(CLS)), "inner", F.array(F.lit(SEP_ID))).alias("ids"))


def first_rare(vocabulary: DataFrame, lookup_bytes: int) -> int | None:
    """The first id of those that are joined; the tokens before it take at most ``lookup_bytes``. None if all do."""
    bucket = F.floor(F.col("token_id") / IDS_TOGETHER).alias("bucket")
    sizes = vocabulary.filter("token_id IS NOT NULL").groupBy(bucket).agg(F.sum(F.octet_length("token") + 12).alias("bytes"))
    taken = 0
    for row in sorted(sizes.collect()):
        taken += row.bytes
        if taken > lookup_bytes:
            return row.bucket * IDS_TOGETHER
    return None


def _lookup(vocabulary: DataFrame) -> tuple[pa.Array, pa.Array]:
    known = vocabulary.toArrow()
    tokens = pa.concat_arrays([known.column("token").combine_chunks(), pa.array([text.SEP_TOKEN])])
    return tokens, pa.concat_arrays([known.column("token_id").combine_chunks(), pa.array([SEP_ID], pa.int32())])


def _bounds(lists: pa.ListArray) -> np.ndarray:
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _looked_up(placed: DataFrame, vocabulary: DataFrame, id_col: str) -> DataFrame:
    tokens, ids = _lookup(vocabulary)
    schema = StructType([placed.schema[id_col], StructField("inner", ArrayType(IntegerType()))])

    def look_up(batches):
        for batch in batches:
            lists = batch.column("kept").fill_null([])
            found = pc.fill_null(ids.take(pc.index_in(lists.flatten(), value_set=tokens)), UNK)
            inner = pa.ListArray.from_arrays(pa.array(_bounds(lists)), found.cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), inner], names=schema.names)

    return placed.mapInArrow(look_up, schema)


def _coded(placed: DataFrame, frequent: DataFrame, id_col: str) -> DataFrame:
    """The id, ``inner`` and ``rare``: the distinct tokens of a text that are not frequent; -1 - i in ``inner`` is the i-th of them."""
    tokens, ids = _lookup(frequent)
    schema = StructType([placed.schema[id_col], *[StructField(n, ArrayType(t())) for n, t in (("inner", IntegerType), ("rare", StringType))]])

    def look_up(batches):
        for batch in batches:
            lists = batch.column("kept").fill_null([])
            words, bounds = lists.flatten(), _bounds(lists)
            found = ids.take(pc.index_in(words, value_set=tokens))
            missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            owner = np.searchsorted(bounds, missing, side="right") - 1
            names = words.take(pa.array(missing)).dictionary_encode()
            most = max(len(names.dictionary), 1)
            pairs, place = np.unique(owner * most + names.indices.to_numpy(), return_inverse=True)
            starts = np.searchsorted(pairs // most, np.arange(batch.num_rows + 1)).astype(np.int32)
            codes = found.fill_null(UNK).to_numpy().astype(np.int32)
            codes[missing] = -1 - (place - starts[owner])
            inner = pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes))
            rare = pa.ListArray.from_arrays(pa.array(starts), names.dictionary.take(pa.array(pairs % most)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), inner, rare], names=schema.names)

    return placed.mapInArrow(look_up, schema)


def _joined(placed: DataFrame, vocabulary: DataFrame, id_col: str, bound: int) -> DataFrame:
    coded = _coded(placed, vocabulary.filter(F.col("token_id") < bound), id_col)
    rows = written(coded.withColumn("_row", F.monotonically_increasing_id()), "token-codes")
    whole, open_rows = rows.filter(F.size("rare") == 0), rows.filter(F.size("rare") > 0)
    words = open_rows.select("_row", F.posexplode("rare").alias("place", "token"))
    words = words.join(vocabulary.filter(F.col("token_id") >= bound).hint("merge"), "token", "left")
    item = F.struct("place", F.coalesce("token_id", F.lit(UNK)).alias("token_id"))
    listed = words.groupBy("_row").agg(F.array_sort(F.collect_list(item)).alias("items"))
    closed = open_rows.join(listed.hint("merge"), "_row")
    inner = F.transform("inner", lambda code: F.when(code < 0, F.get("items", -1 - code)["token_id"]).otherwise(code))
    return whole.select(id_col, "inner").unionByName(closed.select(id_col, inner.alias("inner")))


def pad_to(encoded: DataFrame, length: int) -> DataFrame:
    return _padded(encoded, F.lit(length))


def pad_in_batches(batched: DataFrame, batch: str = "batch") -> DataFrame:
    """Pad to the longest text of the same batch; a batch is a small window."""
    longest = F.max(F.size("ids")).over(Window.partitionBy(batch))
    return _padded(batched.withColumn("_longest", longest), F.col("_longest")).drop("_longest")


def _padded(encoded: DataFrame, length) -> DataFrame:
    return encoded.withColumns(
        {"attention_mask": arrays.attention_mask(F.col("ids"), length), "ids": arrays.pad(F.col("ids"), length, PAD)}
    )


def token_budget(df: DataFrame, columns: list[str]) -> DataFrame:
    """Longest token count of each column, and their sum with one separator a column."""
    longest = df.agg(*[F.max(F.size(text.tokens(F.col(c)))).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return longest.withColumn("max_len", total + F.lit(len(columns)))
