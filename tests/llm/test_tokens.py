"""Token codes and counts against the tokenizers library itself."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from pairloom.llm import queries, token_codes, token_counts  # noqa: E402
from pairloom.llm.pieces import cuts_at_space, read_tokenizer  # noqa: E402

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["a", "word ", "bé ", " ", "\n", "　", " ", "<|endoftext|>", "'s ", "1", "你", "́", "\x1c", " ", "Σ"]


def texts():
    chance = random.Random(2)
    made = ["".join(chance.choice(PARTS) for _ in range(chance.randint(0, 400))) for _ in range(60)]
    rows = list(enumerate(made)) + [(70, "x" * 700), (71, "x" * 700), (72, None), (73, ""), (None, "a b " * 300)]
    return [*rows, rows[5], rows[5], (74, "é" * 90 + " " + "z" * 500)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, t, 1) for i, t in rows], "doc_id long, text string, _text string, k1 int").repartition(3)


def exact(name, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((i, text, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    return out


@pytest.mark.parametrize("name", FILES)
def test_codes(spark, name):
    spec = read_tokenizer(public_tokenizers.path(name))
    assert cuts_at_space(spec)
    found = token_codes.code_documents(frame(spark, texts()), spec, ["doc_id", "k1"], ("ids", "decoded", "ids_sha256")).collect()
    want = [
        (i, 1, ids, decoded, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        for i, _, ids, decoded in exact(name, texts())
    ]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_chunks_of_earlier_blocks(monkeypatch):
    """A copy in a later block is not encoded again, and ids stay the same when chunks are forgotten."""
    spec = read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    coder, counted = token_codes.DocumentCoder(spec), []
    encode = coder._encode_chunks
    coder._encode_chunks = lambda chunks: counted.append(len(chunks)) or encode(chunks)
    copy = " ".join(f"word{i} and {i * i}" for i in range(3000))
    texts = [copy, "x " + copy, copy + " y", "", "short"]
    first, *_ = [coder.encode(pa.array([text])) for text in texts]
    assert counted[0] > 50 and max(counted[1:]) < 8
    assert (coder.encode(pa.array([copy]))[0] == first[0]).all()
    assert first[0].tolist() == coder.tokenizer.encode(copy, add_special_tokens=False).ids
    monkeypatch.setattr(token_codes, "MEMO_CHUNKS", 10)
    assert (coder.encode(pa.array([copy + " z"]))[0][:1000] == first[0][:1000]).all() and len(coder.memo) == 10


@pytest.mark.parametrize("name", FILES)
def test_counts_of_spliced_windows(spark, name):
    spec = read_tokenizer(public_tokenizers.path(name))
    found = token_counts.count_tokens(frame(spark, texts()), spec, ["doc_id"], chunk_chars=50, overlap_chars=4).collect()
    want = [(i, len((text or "").encode()), len(ids)) for i, text, ids, _ in exact(name, texts())]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_windows_cover_the_text():
    assert token_counts.windows(10, [0, 4, 8], 2) == [(0, 0, 6), (4, 6, 10)]
    assert token_counts.windows(9, [0, 4], 2) == [(0, 0, 6), (4, 6, 9)]
    assert token_counts.windows(0, [0], 2) == [(0, 0, 0)]


def test_windows_without_boundaries_join():
    """Only windows on both sides of a place without a common boundary become one, at most ``WIDER`` of them."""
    import pandas as pd

    def parts(good):
        rows = []
        for i in range(len(good) + 1):
            right = [10 * i + 11] if i < len(good) and good[i] else []
            left = [10 * i + 1] if i and good[i - 1] else []
            rows.append((i, 10 * i, 6, left, [1] * len(left), right, [5] * len(right)))
        return pd.DataFrame(rows, columns=["place", "start", "n", "left_at", "left_n", "right_at", "right_n"])

    assert token_counts.splice(parts([True, True])) == (5 + 4 + 5, [])
    assert token_counts.splice(parts([True, False, True, False])) == (None, [0, 10, 30])
    wide = token_counts.splice(parts([False] * 40))
    assert wide == (None, [0, 10 * token_counts.WIDER, 20 * token_counts.WIDER])


def test_long_texts_without_white_space(spark, monkeypatch):
    """Texts over the real chunk size, with no place to cut, between texts that have some."""
    chance = random.Random(5)
    solid = "".join(chance.choice("abcdefgh") for _ in range(300_000))
    spaced = " ".join("".join(chance.choice("abcdefgh") for _ in range(9)) for _ in range(5000))
    rows = [(1, solid), (2, spaced + solid[:60_000] + spaced), (3, spaced), (4, solid)]
    spec = read_tokenizer(public_tokenizers.path(FILES[1]))
    found = token_counts.count_tokens(frame(spark, rows), spec, ["doc_id"]).collect()
    want = [(i, len(text.encode()), len(ids)) for i, text, ids, _ in exact(FILES[1], rows)]
    assert sorted(map(tuple, found)) == sorted(want)
    size, starts, cut = len(solid), list(range(0, len(solid), token_counts.CHUNK_CHARS)), 0
    while len(starts) > 1:
        cut += sum(end - start for start, _, end in token_counts.windows(size, starts, token_counts.OVERLAP_CHARS))
        starts = starts[:: token_counts.WIDER]
    assert cut + size < 3.2 * size


def test_empty_table(spark):
    spec = read_tokenizer(public_tokenizers.path(FILES[1]))
    empty = frame(spark, [(1, "a")]).filter("doc_id > 1")
    assert token_codes.code_documents(empty, spec, ["doc_id"]).count() == 0
    assert token_counts.count_tokens(empty, spec, ["doc_id"]).count() == 0


def test_queries(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    codes = {r.doc_id: r for r in queries.op1_token_codes(spark, sf_dir).collect()}
    for i, _, ids, decoded in exact(FILES[0], rows):
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (codes[i].n_tokens, codes[i].ids_sha256) == (len(ids), digest)
        assert codes[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    counts = {r.doc_id: r for r in queries.op7_token_counts(spark, sf_dir).collect()}
    for i, text, ids, _ in exact(FILES[1], rows):
        assert tuple(counts[i]) == (i, len(text.encode()), len(ids), len(ids) > 512)
