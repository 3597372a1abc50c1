import pytest

from weftline.plans import skew, storage


def test_lookup_join_splits_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(str(i), i) for i in range(20)] + [(None, -1)], "k string, n int")
    right = spark.createDataFrame([("hot", "H"), ("3", "three"), (None, "null")], "k string, v string")
    plain = {how: sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str) for how in ("left", "inner", "left_semi", "left_anti")}
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    for how, want in plain.items():
        assert sorted(map(tuple, skew.lookup_join(left, right, ["k"], how).collect()), key=str) == want
    with pytest.raises(ValueError):
        skew.lookup_join(left, right, ["k"], "outer")


def test_scratch(spark):
    s = storage.Scratch(spark, "t")
    path = s.write(spark.range(3).toDF("x"))
    assert s.read("x bigint", path).count() == 3 and s.read("x bigint").count() == 0
    s.drop(path)
    assert not storage.is_file(spark, path)
