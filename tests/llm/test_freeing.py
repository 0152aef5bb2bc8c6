"""What a task has freed leaves the worker, whose memory counts beside that of later stages."""

import os
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
import pytest

from pairloom.llm import common, pieces, token_codes

SCRIPT = """
import re
from pairloom.llm import common

def held():
    with open("/proc/self/smaps_rollup") as file:
        return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", file.read()))) / 1024

def work(batches):
    for size in batches:
        kept.append([b"x" * size for _ in range(100_000)])
        pins.extend(x[:-1] for x in kept[-1][::500])  # small ones between them stay, as caches of a library do
        pins.append(b"y" * size)
    kept.clear()

    yield held()

kept, pins = [], []
before = held()
list(WRAP(work)([600, 700]))
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="no account of memory")
def test_a_task_leaves_little_behind():
    left = {}
    for name in ("common.freeing", ""):
        script = SCRIPT.replace("WRAP", name)
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        env = os.environ | {"PYTHONPATH": root}
        done = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, check=True)
        left[name] = float(done.stdout.split()[-1])
    assert left["common.freeing"] < 0.6 * left[""]


@pytest.mark.parametrize("fails", [False, True])
def test_memory_goes_back_once_a_task_is_over(monkeypatch, fails):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("back"))

    def work(batches):
        for batch in batches:
            told.append(batch)
            if fails:
                raise ValueError
            yield batch

    try:
        assert list(common.freeing(work)([1, 2])) == [1, 2]
    except ValueError:
        assert fails
    assert told == ([1, "back"] if fails else [1, 2, "back"])


class Recorder:
    def __init__(self, tokenizer):
        self.tokenizer, self.sizes = tokenizer, []

    def encode_batch_fast(self, words, **more):
        self.sizes.append(len(words))
        return self.tokenizer.encode_batch_fast(words, **more)


def test_new_pieces_go_through_the_tokenizer_in_parts():
    encoder = pieces.PieceEncoder(pieces.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    encoder.tokenizer = told = Recorder(encoder.tokenizer)
    words = [f" piece{i} é{i % 7}" for i in range(9_000)] + ["", " again"]
    at = encoder.look_up(pa.array([*words, *words[::-1]]))
    assert max(told.sizes) <= 4_096 and sum(told.sizes) == len(words)
    want = [one.ids for one in told.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    got = [encoder.flat[encoder.starts[i] : encoder.starts[i] + encoder.lengths[i]].tolist() for i in at]
    assert got == want + want[::-1]


def test_a_kept_text_goes_to_python_once(spark, monkeypatch):
    texts = [None, "", "some words", "some words", "é 日本 " * 5_000, *[f"word{i} other {i * 7}" for i in range(300)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    sent, to_python = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, *args: sent.append(df.columns) or to_python(df, *args))
    spec = pieces.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    outputs = ("n_tokens", "ids", "decoded_sha256")
    kept = token_codes.code_documents(docs, spec, ["doc_id", "text"], outputs, size=1_000)
    rows = sorted(kept.collect())
    assert len(sent[0]) == 2
    assert [r.text for r in rows] == texts
    plain = sorted(token_codes.code_documents(docs, spec, ["doc_id"], outputs).collect())
    assert [(r.doc_id, *r[2:]) for r in rows] == [tuple(r) for r in plain]


@pytest.mark.parametrize("bound, held", [("1048576", "1048576"), (str(64 << 20), str(4 << 20)), ("64m", str(4 << 20))])
def test_a_smaller_bound_on_batches_stays(spark, monkeypatch, bound, held):
    seen = []
    monkeypatch.setattr(common, "written", lambda df, name: seen.append(spark.conf.get(common.BATCH_BYTES)) or df)
    before = spark.conf.get(common.BATCH_BYTES)
    spark.conf.set(common.BATCH_BYTES, bound)
    try:
        common.stored(spark.range(1), "any")
        assert spark.conf.get(common.BATCH_BYTES) == bound
    finally:
        spark.conf.set(common.BATCH_BYTES, before)
    assert seen == [held]
