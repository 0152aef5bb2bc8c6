"""Periodic runs against a word-by-word search, private spans against plain regular expressions, whitening against numpy."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import periodic_runs, private_spans, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=6, times=4):
    """All lags, word by word."""
    found = []
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            stretch = words[start : start + length]
            smaller = any(all(stretch[j] == stretch[j + d] for j in range(length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                found.append((start, length, q))
    return sorted((s, n, q) for s, n, q in found)


def brute_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, = (g % n,)
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [True] * n
    for start, length, q in runs:
        for i in range(start + q, start + length):
            kept[i] = False
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(" ".join(w for w, k in zip(words, kept) if k).encode()).hexdigest(),
    )


def random_texts():
    chance = np.random.default_rng(5)
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "a b a b a b a", "  x y " * 9]
    for _ in range(150):
        letters = chance.integers(1, 4)
        parts = []
        for _ in range(chance.integers(1, 5)):
            unit = [chr(97 + int(c)) for c in chance.integers(0, letters, chance.integers(1, 14))]
            parts += unit * int(chance.integers(1, 8)) + unit[: int(chance.integers(0, len(unit) + 1))]
        texts.append(" ".join(parts))
    unit = [f"w{i}" for i in range(60)]
    texts += [" ".join(unit * 5), " ".join(["x", *unit * 4, "y", *unit * 4]), "z " * 3000, " ".join((["a"] * 7 + ["b"]) * 9)]
    return texts


def test_runs_equal_brute_force(spark):
    texts = random_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("runs", F.lit(1)).repartition(3)
    found = periodic_runs.collapse_runs(rows, ["id"]).collect()
    assert len(found) == len(texts)
    for row in found:
        words = WORD.findall(texts[row.id] or "")
        assert [tuple(r) for r in row.runs] == brute_runs(words), texts[row.id]
        dropped = {i for s, n, q in brute_runs(words) for i in range(s + q, s + n)}
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert row.n_words == len(words)


def test_run_bounds_are_settings(spark):
    rows = spark.createDataFrame([(1, "a b a b a b c c c c")], "id long, text string")
    three = periodic_runs.collapse_runs(rows, ["id"], least_words=3, least_periods=3).first()
    assert [tuple(r) for r in three.runs] == [(0, 6, 2), (6, 4, 1)] and three.collapsed == "a b c"
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(rows, ["id"], least_periods=2)


def test_hot_gram_gives_few_pairs():
    """A text of one word has a seed for each place, not for each pair of places."""
    hashes = np.full(50_000, 7, np.uint64)
    place, lag = periodic_runs.seed_pairs(hashes, np.array([0, 50_000]), 1, 1, 5)
    assert len(place) < 50_000
    assert [len(x) for x in periodic_runs.find_runs(hashes, np.array([0, 50_000]))] == [1, 1, 1]


def test_runs_query(spark, tmp_path):
    chance = np.random.default_rng(2)
    rows = [(i, " ".join(chr(97 + int(c)) for c in chance.integers(0, 26, chance.integers(0, 90))), 1) for i in range(300)]
    rows += [(1000 + i, text, 2) for i, text in enumerate(random_texts())] + [(None, "b b b b b b b", 3), (7, rows[7][1], 4)]
    spark.createDataFrame(rows, "doc_id long, text string, words int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    own = {(i, brute_digest(i, t)) for i, t, _ in rows if i is not None}
    assert {(r.doc_id, tuple(r[n] for n in names)) for r in found if r.doc_id is not None} == own
    assert len(found) == len(rows) and sum(r.n_runs > 0 for r in found) > 100
    (unnamed,) = (r for r in found if r.doc_id is None)
    assert (unnamed.n_runs, unnamed.length) == (1, 7)


def test_runs_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, text string")
    assert periodic_runs.collapse_runs(rows, ["id"]).count() == 0


# ---- private spans -----------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_base(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for found in re.finditer(pattern, text or ""):
            m = found.group()
            digits = re.sub("[^0-9]", "", m)
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((kind, *found.span()))
    return spans


SPAN_TEXTS = [
    None, "", "nothing", "a@b.c", "a@b.cd_e@f.gh x@y@z.w .@d.e", "a@b.c.@d.e", "%%@--.-.", "a@b a@b.", "1.2.3.4.5.6.7.8", "0255.01.2.3 256.1.1.1",
    "1.2.3.a 1.2", "4111 1111 1111 1111", "4111-1111-1111-1112", "x4111111111111111y", "5 5  5", "+1 (988) 555-2485.", "+12", "+1 ( ", "+1 234567890123456",
    "é@é.é naïve@exämple.com 😀 +49 (0) 30 123456 😀 10.0.0.1", "4111 1111 1111 1111 4111 1111 1111 1111",
]


def spans_of(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, spans string").repartition(2)
    return {r.id: [tuple(s) for s in r.spans] for r in private_spans.find_spans(rows, ["id"]).collect()}


def test_base_spans_equal_plain_patterns(spark):
    chance = np.random.default_rng(3)
    signs = ["a", "7", "1", "4", "@", ".", " ", "-", "+", "(", ")", "_", "%", "é", "😀", "12", "255"]
    texts = SPAN_TEXTS + ["".join(signs[i] for i in chance.integers(0, len(signs), chance.integers(1, 120))) for _ in range(400)]
    texts += [" ".join(["a@b.c 1.2.3.4"] * 700)]
    found = spans_of(spark, texts)
    for i, text in enumerate(texts):
        assert [s[:3] for s in found[i] if s[4]] == plain_base(text), text


def test_checked_and_scored_spans(spark):
    texts = [
        "pay to GB82 WEST 1234 5698 7654 32 PLEASE",
        "pay to GB83 WEST 1234 5698 7654 32",
        "DE89370400440532013000, XDE89370400440532013000 DE89370400440532013000x",
        "ZZ89370400440532013000",
        "my SSN is 123-45-6789",
        "part 123-45-6789",
        "SSN 000-45-6789, SSN 666-45-6789, SSN 123-00-6789, ssn 123-45-67890",
        "call (212) 555-0187 now",
        "(212) 555-0187",
        "phone +1 (212) 555-0187",
    ]
    found = spans_of(spark, texts)
    text = lambda i: [(s[0], texts[i][s[1] : s[2]]) for s in found[i]]
    assert text(0) == [("iban", "GB82 WEST 1234 5698 7654 32")] and found[0][0][3] == pytest.approx(0.6)
    assert text(1) == [] and text(3) == []
    assert text(2) == [("iban", "DE89370400440532013000")] and found[2][0][1] == 0
    assert text(4) == [("ssn", "123-45-6789")] and found[4][0][3] == pytest.approx(0.6)
    assert text(5) == [] and text(6) == []
    assert text(7) == [("tel", "(212) 555-0187")] and text(8) == []
    assert text(9) == [("phone", "+1 (212) 555-0187")]
    assert found[9][0][3] == pytest.approx(0.9)  # a word of the kind stands near


@pytest.mark.parametrize("long", ["a" * 400_000, "7" * 400_000, "a." * 200_000, "1." * 200_000, "+1" + " " * 400_000, "a@" * 200_000])
def test_long_stretches(spark, long):
    found = spans_of(spark, [long + " x@y.zz"])[0]
    assert ("email", len(long) + 1, len(long) + 7) in [s[:3] for s in found]


def test_many_spans_in_one_text(spark):
    found = spans_of(spark, ["éa@b.cd " * 20_000])[0]
    assert [s[1] for s in found] == list(range(1, 8 * 20_000, 8))


def test_spans_stay_in_the_jvm(spark, sf_dir):
    df = queries.QUERIES["op12_private_spans"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Exchange"))


# ---- whitening ---------------------------------------------------------------------


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 5, 40), np.geomspace(1e-9, 1e3, 24), [3.0] * 7, [0.0] * 5, [2.0, 2.0, 2.0, 1.0, 1.0, 0.0], [1e12, 1, 1, 1e-6],
        [4.0], [-2.0, 0.0, 2.0], np.random.default_rng(1).chisquare(3, 64), [1.0, 1.0 + 1e-12, 1.0 - 1e-12, 5.0],
    ],
)
def test_spectral_components(values):
    a = symmetric(values)
    found, vectors = whitening.spectral_components(a)
    norm = np.linalg.norm(a)
    assert found == pytest.approx(np.sort(values)[::-1], abs=1e-12 * max(norm, 1e-300))
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * found).max() <= 1e-12 * max(norm, 1e-300)
    few, _ = whitening.spectral_components(a, 3)
    assert few == pytest.approx(found[:3], abs=1e-12 * max(norm, 1e-300))


def test_polar_is_the_sign():
    values = np.array([-5.0, -1e-6, 1e-3, 2, 7])
    a = symmetric(values, 4)
    w, v = np.linalg.eigh(a)
    assert whitening.polar(a) == pytest.approx((v * np.sign(w)) @ v.T, abs=1e-9)


def check_whitened(rows, found, wanted=8):
    """Against exact sums and a library decomposition; rows are (vec_id, entries) that take part."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], object)
    n, d = x.shape
    total = x.sum(0)
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, total)] for row in x])
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1].T
    deviation = {}
    for (key, _), row in zip(rows, x):
        deviation[key] = sum(int(n * a - s) ** 2 for a, s in zip(row, total))
    frame = found.toPandas()
    assert len(frame) == n * min(d, wanted) and set(frame["n"]) == {n}
    assert all(deviation[k] == v for k, v in zip(frame["vec_id"], frame["deviation"]))
    assert frame["identity_error"].max() < 1e-9
    place = {key: i for i, (key, _) in enumerate(rows)}
    for component, part in frame.groupby("component"):
        assert part["explained"].iloc[0] == pytest.approx(e[component - 1] / np.trace(v), rel=1e-10)
        want = centred[[place[k] for k in part["vec_id"]]] @ axes[component - 1] / np.sqrt(e[component - 1])
        got = part["whitened"].to_numpy()
        sign = np.sign(got @ want)
        assert got == pytest.approx(sign * want, abs=1e-8)


def test_whitening(spark):
    chance = np.random.default_rng(8)
    rows = [(i, (chance.standard_normal(12) * np.arange(1, 13) * 0.1).tolist()) for i in range(300)]
    bad = [(900, None), (901, [float("nan")] + [1.0] * 11), (902, [float("inf")] * 12), (903, [None] + [1.0] * 11), (904, []), (905, [1.0])]
    bad += [(906, [1e300] * 12)]
    frame = spark.createDataFrame([(i, v, 3) for i, v in rows + bad], "vec_id long, embedding array<double>, n int").repartition(5)
    found = whitening.whiten(frame, ["vec_id"])
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitened(rows, found)
    assert whitening.whiten(frame, ["vec_id"], wanted=None).count() == 300 * 12


def test_whitening_query(spark, sf_dir):
    found = queries.QUERIES["op13_whitening"](spark, sf_dir)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitened(rows, found)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema), ["vec_id"]).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema), ["vec_id"]).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(1, 0.0, 0.0, 0, None), (2, 0.0, 0.0, 0, None)]
    line = [(i, [float(i), float(i)]) for i in range(4)] + [(None, [1.0, 1.0]), (2, [2.0, 2.0])]
    rows = whitening.whiten(spark.createDataFrame(line, schema), ["vec_id"]).collect()
    assert {r.whitened for r in rows if r.component == 2} == {0.0} and rows[0].identity_error < 1e-9


def test_exact_beyond_longs():
    centre = whitening.Centre(3_000_000_000, np.array([3_000_000_000 * 100_000] * 2, object))
    moved = centre.moved(np.array([[100_000, 100_001], [200_000, 100_000]]))
    assert centre.deviations(moved)[0] == 9 * 10**18 and centre.deviations(moved)[1] is None
