"""Encode and decode whole documents with a given BPE tokenizer, reusing content-defined chunks.

A rolling hash over the bytes cuts a text into chunks, so documents that share a passage share its chunks wherever
the passage stands. A chunk met again is not encoded again: its ids are copied. A cut may fall inside a word, where
the tokens of both sides are wrong, so each join is repaired: the window around the cut widens on both sides to the
nearest proven boundaries (see ``pieces``), from which on both encodings agree whatever stands beyond, and the window
is encoded by itself. Chunks are shared inside a task: equal ones of a block are encoded once, and the ids of the last
``MEMO_CHUNKS`` distinct chunks, by 128-bit hash, serve later blocks. The distinct pieces below them are remembered, too.
They are not shared between tasks, as that would send every text and every id through a shuffle.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; rows are kept
one by one, repeated ids included; extra columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import freeing, give_back
from pairloom.llm.pieces import PieceEncoder, blocks, buffers, spans, strings, sums_between

HASH_STEPS = (1, 2, 4, 8)  # doubling the window of the rolling hash: 16 bytes at last
CHUNK_BITS = 8  # a cut every 256 bytes on average
TEXT_BYTES = 1 << 20  # of texts that a task codes together; coding takes some forty times as much
CODED_PIECES = 100_000  # distinct pieces that a task remembers beside them
MEMO_CHUNKS = 1 << 15  # distinct chunks whose ids a task remembers, about 8 MB of text
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def gear_table(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_cuts(data: np.ndarray, gear: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Places whose preceding 16 bytes hash to zero in the upper ``bits`` bits."""
    state = gear[data]
    for step in HASH_STEPS:
        wider = state.copy()
        wider[step:] += state[:-step] << np.uint32(step)
        state = wider
    return np.flatnonzero((state >> np.uint32(32 - bits)) == 0) + 1


def chunk_bounds(offsets: np.ndarray, cuts: np.ndarray, proven: np.ndarray) -> np.ndarray:
    """Bounds of chunks and of the repaired windows between them."""
    cuts = cuts[cuts < offsets[-1]]
    left = proven[np.searchsorted(proven, cuts, side="right") - 1]
    right = proven[np.searchsorted(proven, cuts, side="left")]
    return np.unique(np.concatenate([offsets, left, right]))


class DocumentCoder:
    def __init__(self, spec: str):
        self.pieces = PieceEncoder(spec, CODED_PIECES)
        self.tokenizer = self.pieces.tokenizer
        self.gear = gear_table()
        self.memo: dict[bytes, bytes] = {}  # hash of a chunk and its ids, the oldest first
        self.names = None
        if self.tokenizer.decoder is None:  # tokens are joined by spaces then
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.names = pa.array([self.tokenizer.id_to_token(i) or "" for i in range(size)], pa.string())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text."""
        offsets, data = buffers(texts)
        proven = self.pieces.boundaries(offsets, data)
        bounds = chunk_bounds(offsets, rolling_cuts(data, self.gear), proven) if self.pieces.cuts else proven
        coded = strings(bounds, data).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        chunk_ids, chunk_at = self._recall_chunks(coded.dictionary)
        lengths = (chunk_at[1:] - chunk_at[:-1])[which]
        ids = chunk_ids[spans(chunk_at[:-1][which], lengths)]
        per_text = sums_between(lengths, np.searchsorted(bounds, offsets))
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def _recall_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and the bounds of each, encoding only those that are not remembered."""
        offsets, data = buffers(chunks)
        whole, at = memoryview(data), offsets.tolist()
        keys = [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
        coded = [self.memo.get(key) for key in keys]
        fresh = [i for i, ids in enumerate(coded) if ids is None]
        if fresh:
            ids, bounds = self._encode_chunks(chunks.take(pa.array(fresh, pa.int64())))
            raw, ends = ids.astype(np.int32).tobytes(), (bounds * 4).tolist()
            for i, a, b in zip(fresh, ends[:-1], ends[1:]):
                coded[i] = self.memo[keys[i]] = raw[a:b]
            for key in list(islice(self.memo, max(len(self.memo) - MEMO_CHUNKS, 0))):
                del self.memo[key]
        lengths = np.array([len(ids) // 4 for ids in coded], np.int64)
        return np.frombuffer(b"".join(coded), np.int32), np.concatenate([[0], np.cumsum(lengths)])

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = buffers(chunks)
        bounds = self.pieces.boundaries(offsets, data)
        at = self.pieces.look_up(strings(bounds, data))
        lengths = self.pieces.lengths[at]
        ids = self.pieces.flat[spans(self.pieces.starts[at], lengths)]
        per_chunk = sums_between(lengths, np.searchsorted(bounds, offsets))
        return ids, np.concatenate([[0], np.cumsum(per_chunk)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        if self.names is None:
            listed = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            return pa.array(self.tokenizer.decode_batch(listed, skip_special_tokens=False), pa.string())
        tokens = self.names.take(pa.array(ids.astype(np.int32)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens), " ")


def _digests(data: memoryview, bounds: np.ndarray) -> list[str]:
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def code_documents(
    docs: DataFrame,
    spec: str,
    keep: list[str],
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    text: str = "text",
    size: int = TEXT_BYTES,
) -> DataFrame:
    """Columns of ``keep``, then ``outputs`` (names of OUTPUTS) for each document; no shuffle.

    Texts of about ``size`` bytes are coded together: fewer take less memory and more time.
    """
    kept = [f"_k{i}" for i in range(len(keep))]
    column = f"_k{keep.index(text)}" if text in keep else "_text"  # a text that is kept goes to Python once
    chosen = docs.select(
        *[F.col(c).alias(name) for c, name in zip(keep, kept)], *([] if text in keep else [F.col(text).alias(column)])
    )
    schema = T.StructType(
        [T.StructField(c, chosen.schema[i].dataType) for i, c in enumerate(keep)]
        + [T.StructField(name, OUTPUTS[name]) for name in outputs]
    )

    def code(batches):
        coder = DocumentCoder(spec)
        for whole in batches:
            give_back()  # what reading the tokenizer's file and the batch before have freed
            for batch in blocks(whole, column, size):
                ids, bounds = coder.encode(batch.column(column).fill_null(""))
                found = {}
                if "n_tokens" in outputs:
                    found["n_tokens"] = pa.array(np.diff(bounds), pa.int64())
                if "ids" in outputs:
                    found["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                if "ids_sha256" in outputs:
                    found["ids_sha256"] = pa.array(_digests(memoryview(ids.astype("<u4").tobytes()), bounds * 4))
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    decoded = coder.decode(ids, bounds)
                    found["decoded"] = decoded
                    if "decoded_sha256" in outputs:
                        at, data = buffers(decoded)
                        found["decoded_sha256"] = pa.array(_digests(memoryview(data), at))
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, kept), *[found[name] for name in outputs]], names=[*keep, *outputs]
                )

    return chosen.mapInArrow(freeing(code), schema)
