"""Cut texts where a tokenizer is proven to cut them, and encode distinct pieces once.

A *proven boundary* lies before ASCII white space that follows a character which is no white space. No match of
the tokenizers' word patterns runs over it: letters, digits and other signs form runs of their own, and white space
stands only at the head of a match or alone. What lies left of the boundary cannot change the tokens right of it,
as the patterns look ahead only, and added tokens hold no white space. So the ids of a text are the ids of its
pieces, one after the other. ``cuts_at_space`` tells whether a tokenizer file has this property; for any other
tokenizer a whole text is one piece.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa

MEMO_PIECES = 300_000  # distinct pieces remembered by a task before it starts afresh
BLOCK_BYTES = 3 << 20  # text bytes looked at together
ENCODED_PIECES = 4_096  # new pieces that go through the tokenizer at once; what it returns takes a hundred times their size


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text; it travels inside the tasks, so executors need no such file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def cuts_at_space(spec: str) -> bool:
    """Whether no token crosses a proven boundary, judged from the tokenizer's own description."""
    found = json.loads(spec)
    pre = found.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    kinds = [step.get("type") for step in steps]
    plain_added = all(
        not any(char.isspace() for char in token["content"]) and not token["lstrip"] and not token["rstrip"]
        for token in found.get("added_tokens", [])
    )
    if not plain_added or any(step.get("add_prefix_space") for step in steps):
        return False
    if kinds == ["ByteLevel"]:
        return bool(steps[0].get("use_regex")) and not found.get("normalizer")
    drops_space = kinds == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    return bool(drops_space and "\\s\\p{L}" in steps[0]["pattern"].get("Regex", "") and not steps[1].get("use_regex"))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of an Arrow string array without nulls."""
    texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def strings(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    """The strings between neighbouring bounds, without a copy of the bytes."""
    offsets = np.ascontiguousarray(bounds, np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def proven_boundaries(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Sorted places inside the bytes where pieces begin; text ends included."""
    size = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    at = np.flatnonzero(space)
    at = at[at > 0]
    before = data[at - 1]
    good = ~space[at - 1] & ((before < 28) | (before > 31))
    # Multi-byte white space ends in one of these bytes; signs that share its lead are left uncut as well.
    second, third = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    good &= ~((second == 0xC2) & ((before == 0x85) | (before == 0xA0)))
    good &= ~((third >= 0xE1) & (third <= 0xE3) & ((second == 0x80) | (second == 0x81) | (second == 0x9A)))
    begins = np.zeros(size + 1, bool)
    begins[at[good]] = True
    begins[offsets] = True
    return np.flatnonzero(begins)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the stretches ``starts[i] ... starts[i] + lengths[i] - 1``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``; empty stretches give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


class PieceEncoder:
    """Encodes arrays of pieces; each distinct piece goes through the tokenizer once for a task."""

    def __init__(self, spec: str, memo: int | None = None):
        self.memo_pieces = MEMO_PIECES if memo is None else memo
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cuts = cuts_at_space(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self):
        self.places: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def boundaries(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        return proven_boundaries(offsets, data) if self.cuts else np.unique(offsets)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids one after the other."""
        lengths, flat = [], []
        for start in range(0, len(words), ENCODED_PIECES):
            found = self.tokenizer.encode_batch_fast(words[start : start + ENCODED_PIECES], add_special_tokens=False)
            ids = [one.ids for one in found]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(lengths), np.concatenate(flat)

    def look_up(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece in the memo, after encoding those not met before."""
        if len(self.places) > self.memo_pieces:
            self._forget()
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [word for word in words if word not in self.places]
        if new:
            lengths, flat = self._encode(new)
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            first = len(self.places)
            self.places.update(zip(new, range(first, first + len(new))))
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = np.concatenate([self.starts, starts])
            self.flat = np.concatenate([self.flat, flat])
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        return at[coded.indices.to_numpy(zero_copy_only=False)]


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES):
    """Slices of a batch whose texts hold about ``size`` bytes; a longer text is a slice of its own."""
    offsets, _ = buffers(batch.column(column).fill_null(""))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end
