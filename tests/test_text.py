from pyspark.sql import functions as F

from pairloom.functions import arrays, text


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_brackets(spark):
    got = values(spark, text.without_brackets(F.lit("a (b) c [d] {e}")), text.without_brackets(F.lit("x (y] z")))
    assert got == ["a  c  ", "x  z"]


def test_description_by_symbol_length(spark):
    df = spark.createDataFrame([("A01", "Farming (old)"), ("A01B", "Soil")], "symbol string, d string")
    got = [row[0] for row in df.select(text.description_for("symbol", "d")).collect()]
    assert got == ["farming ", ""]


def test_model_text(spark):
    rows = [
        ("a", "t", "H01", "section", "class", "H02; H03"),
        ("a", "t", "H01", "section", None, None),
        ("a", None, "H01", "section", "class", None),
    ]
    df = spark.createDataFrame(
        rows, "anchor string, target string, context string, text_grp_1 string, text_grp_2 string, mentioned_groups_grp_2 string"
    )
    plain = [row[0] for row in df.select(text.model_text()).collect()]
    assert plain == ["a[SEP]t[SEP]section; class", "a[SEP]t[SEP]section", None]
    long = [row[0] for row in df.select(text.model_text(use_mentions=True)).collect()]
    assert long == ["a[SEP]t[SEP]section; class[SEP]H01[SEP]H02; H03", "a[SEP]t[SEP]section[SEP]H01", None]
    short = [row[0] for row in df.select(text.model_text(use_class_text=False)).collect()]
    assert short[0] == "a[SEP]t[SEP]section"


def test_tokens(spark):
    got = values(spark, text.tokens(F.lit("Größe-x, 12![SEP]y")), text.tokens(F.lit(None).cast("string")))
    assert got == [["größe", "-", "x", ",", "12", "!", "[sep]", "y"], []]


def test_shingles(spark):
    got = values(spark, text.shingles(F.lit("abcab"), 2), text.shingles(F.lit("a"), 2), text.shingles(F.lit(""), 3))
    assert got == [["ab", "bc", "ca"], [], []]


def test_set_text(spark):
    got = values(spark, text.set_text(F.array(F.lit("b"), F.lit("a"))), text.set_text(F.array().cast("array<string>")))
    assert got == ["a; b", ""]


def test_class_arrays(spark):
    scores = spark.createDataFrame([(0.0,), (0.75,), (1.0,), (0.3,), (None,)], "score double")
    assert [row[0] for row in scores.select(arrays.class_of_score("score")).collect()] == [0, 3, 4, None, None]
    got = values(
        spark,
        arrays.one_hot(F.lit(3)),
        arrays.arg_max(F.array(*[F.lit(x) for x in (0.0, 0.2, 0.7, 0.7, 0.1)])),
        arrays.sigmoid(F.lit(0.0)),
    )
    assert got == [[0, 0, 0, 1, 0], 2, 0.5]


def test_padding(spark):
    ids = F.array(F.lit(1), F.lit(7), F.lit(2))
    got = values(spark, arrays.pad(ids, F.lit(5)), arrays.attention_mask(ids, F.lit(5)))
    assert got == [[1, 7, 2, 0, 0], [1, 1, 1, 0, 0]]


def test_layer_norm(spark):
    got = values(spark, arrays.layer_norm(F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0)])))[0]
    scale = (2 / 3 + 1e-5) ** 0.5
    assert [round(x, 9) for x in got] == [round((x - 2) / scale, 9) for x in (1, 2, 3)]


def test_binary_digits(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "i int")
    assert [list(row) for row in df.select(*arrays.binary_digits(F.col("i"), 3)).collect()] == [
        [0, 0, 1],
        [0, 1, 0],
        [1, 0, 0],
    ]
