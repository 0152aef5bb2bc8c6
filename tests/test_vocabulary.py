import pytest
from pyspark.sql import functions as F

from pairloom import session
from pairloom.operators import pooling, vocabulary


def texts(spark):
    return spark.createDataFrame([(1, "b a a c"), (2, "a b"), (3, None), (4, "zz a")], "doc_id int, text string")


def test_encode(spark):
    words = vocabulary.build_vocabulary(texts(spark), "text", 2)
    assert {row.token: row.token_id for row in words.collect()} == {"a": 4, "b": 5}
    rows = {row.doc_id: row.ids for row in vocabulary.encode(texts(spark), words, "doc_id", "text", 5).collect()}
    assert rows == {1: [1, 5, 4, 4, 2], 2: [1, 4, 5, 2], 3: [1, 2], 4: [1, 3, 4, 2]}


def test_joined_vocabulary_gives_the_same(spark):
    df = texts(spark).unionByName(spark.createDataFrame([(1, "c c"), (None, "b")], "doc_id int, text string"))
    words = vocabulary.build_vocabulary(df, "text")
    assert words.count() == 4
    by = [
        sorted((str(r.doc_id), r.ids) for r in vocabulary.encode(df, words, "doc_id", "text", lookup_bytes=size).collect())
        for size in (1 << 20, 0)
    ]
    assert by[0] == by[1] and len(by[0]) == 6
    plan = vocabulary.encode(df, words, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange SinglePartition", "")


def test_only_rare_tokens_are_joined(spark, monkeypatch):
    """Of a vocabulary above the bound the frequent tokens are looked up; a text hands on each rare one once, and texts without stay."""
    held = []

    def written(table, name):
        held.append(session.written(table, name))
        return held[-1]

    monkeypatch.setattr(vocabulary, "IDS_TOGETHER", 1)
    rows = [(1, "a b a rare b rare x a"), (2, "a [SEP] b"), (2, None), (3, "b odd a odd rare new"), (None, "a b b")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    words = vocabulary.build_vocabulary(df, "text").filter("token <> 'new'")
    assert vocabulary.first_rare(words, 2 * 13) == 6 and vocabulary.first_rare(words, 1 << 20) is None
    monkeypatch.setattr(vocabulary, "written", written)
    by = [
        sorted((str(r.doc_id), r.ids) for r in vocabulary.encode(df, words, "doc_id", "text", lookup_bytes=size).collect())
        for size in (1 << 20, 2 * 13, 0)
    ]
    assert by[0] == by[1] == by[2] and len(by[0]) == 5
    assert sorted(sorted(row.rare) for row in held[0].collect()) == [[], [], [], ["new", "odd", "rare"], ["rare", "x"]]


def test_separator_has_its_own_id(spark):
    df = spark.createDataFrame([(1, "a[SEP]b[SEP]a")], "doc_id int, text string")
    words = vocabulary.build_vocabulary(df, "text", 2)
    assert vocabulary.encode(df, words, "doc_id", "text", 99).first().ids == [1, 4, 2, 5, 2, 4, 2]


def test_padding(spark):
    encoded = spark.createDataFrame([(1, 0, [1, 4, 2]), (2, 0, [1, 2]), (3, 1, [1, 2])], "id int, batch int, ids array<int>")
    rows = {row.id: (row.ids, row.attention_mask) for row in vocabulary.pad_in_batches(encoded).collect()}
    assert rows == {1: ([1, 4, 2], [1, 1, 1]), 2: ([1, 2, 0], [1, 1, 0]), 3: ([1, 2], [1, 1])}
    assert [row.ids for row in vocabulary.pad_to(encoded, 4).orderBy("id").collect()][1] == [1, 2, 0, 0]


def test_budget(spark):
    df = spark.createDataFrame([("a b", None), ("a", "x, y")], "anchor string, target string")
    got = vocabulary.token_budget(df, ["anchor", "target"]).first()
    assert (got.anchor, got.target, got.max_len) == (2, 3, 7)


VECTORS = [("g", [1.0, 2.0], 1, 0.0), ("g", [3.0, 6.0], 1, 1.0), ("g", [100.0, 100.0], 0, 2.0), ("h", [5.0, 5.0], 0, 800.0)]


def vectors(spark):
    return spark.createDataFrame(VECTORS, "grp string, v array<double>, mask int, s double")


def pooled(df):
    return {(row.grp, row.place): row.value for row in df.collect()}


def test_mean_pool(spark):
    got = pooled(pooling.mean_pool(vectors(spark), "grp", "v", F.col("mask")))
    assert got == {("g", 0): 2.0, ("g", 1): 4.0, ("h", 0): 0.0, ("h", 1): 0.0}


def attention(spark):
    return pooled(pooling.attention_pool(vectors(spark), "grp", "v", F.col("s")))


def test_attention_pool(spark):
    from math import exp

    weights = [exp(s - 2) for s in (0.0, 1.0, 2.0)]
    got = attention(spark)
    assert got[("g", 0)] == pytest.approx(sum(w * x for w, x in zip(weights, (1, 3, 100))) / sum(weights))
    assert got[("h", 1)] == 5.0


def test_attention_pool_by_shuffle(spark, monkeypatch):
    from pairloom import session

    small = attention(spark)
    monkeypatch.setattr(session, "SMALL_SIDE_ROWS", 0)
    assert attention(spark) == pytest.approx(small)
