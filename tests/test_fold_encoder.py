import pytest
from pyspark.sql import functions as F

from pairloom.operators import fold_encoder as fe
from pairloom.session import scratch_path


@pytest.mark.parametrize("choice, width", [(True, 3), ("digits", 3), ("onehot", 4), ({0: [0.5, 1], 1: [2, 3], 2: [4, 5], 3: [6, 7.25]}, 2)])
def test_stored_encoder_encodes_the_same(spark, choice, width):
    encoder = fe.fit_encoder(choice, [0, 1, 2, 3])
    path = scratch_path(spark, "encoder")
    encoder.save(spark, path)
    again = fe.FoldEncoder.load(spark, path)
    assert again.names == encoder.names and again.table == encoder.table and len(again.names) == width
    rows = again.encoded(spark.range(4).select(F.col("id").cast("int").alias("fold"))).collect()
    for row in rows:
        assert tuple(row[name] for name in again.names) == encoder.values(row.fold)


def test_one_hot_and_digits():
    assert fe.one_hot([0, 2]).table == {0: (1.0, 0.0), 2: (0.0, 1.0)}
    assert fe.digits([0, 1, 2, 3]).table[2] == (0.0, 1.0, 1.0)


@pytest.mark.parametrize("choice", [True, "onehot", {0: [1], 1: [2]}])
def test_unseen_folds_are_an_error(spark, choice):
    encoder = fe.fit_encoder(choice, [0, 1])
    with pytest.raises(ValueError):
        encoder.values(7)
    for unseen in (7, None):
        with pytest.raises(Exception, match="no values for fold"):
            encoder.encoded(spark.createDataFrame([(unseen,)], "fold int")).collect()


def test_settings():
    assert fe.fit_encoder(False, [0]) is None
    for wrong in ("hash", {0: [1.0]}, {0: [1.0], 1: [1.0, 2.0]}):
        with pytest.raises(ValueError):
            fe.fit_encoder(wrong, [0, 1])
