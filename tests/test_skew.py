from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholark.operators import skew

ROWS = [(1, 10, "a", 5)] * 60 + [(2, 10 + i % 3, "b", i) for i in range(30)] + [(None, 1, "c", 1)] * 5 + [(i + 100, 7, None, 2) for i in range(20)]
SCHEMA = "k bigint, v bigint, n_rows string, x int"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_heavy_keys_are_exact(rows):
    found = {(r.key_field, r.key_id): r.n_rows for r in skew.heavy_keys(rows, ["k", "v"], 0.1).collect()}
    total = len(ROWS)
    want = {(f, key): n for f, i in (("k", 0), ("v", 1)) for key, n in Counter(r[i] for r in ROWS).items() if key is not None and n >= 0.1 * total}
    assert found == want


def test_no_heavy_keys_in_an_empty_table(spark):
    assert skew.heavy_keys(spark.createDataFrame([], SCHEMA), ["k"], 0.1).count() == 0


def test_too_small_a_share_is_refused(rows):
    with pytest.raises(ValueError):
        skew.heavy_keys(rows, ["k"], 1e-6)


@pytest.mark.parametrize("limit", [10_000, 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_a_plain_join(spark, rows, how, limit, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (105, "w"), (None, "null")], "k bigint, name string")
    got = sorted(map(str, skew.skew_join(rows, right, "k", 0.1, how).select("k", "v", "x", "name").collect()))
    assert got == sorted(map(str, rows.join(right, "k", how).select("k", "v", "x", "name").collect()))


def test_clashing_columns_are_refused(rows):
    with pytest.raises(ValueError):
        skew.skew_join(rows, rows, "k")


@pytest.mark.parametrize("heavy", [None, [], [1, 2]])
def test_skew_aggregate_equals_a_plain_one(rows, heavy):
    got = skew.skew_aggregate(rows.drop("n_rows"), "k", {"s": F.col("x")}, {"lo": F.col("x")}, {"hi": F.col("x")}, {"d": F.col("v")}, 0.1, heavy)
    want = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.countDistinct("v").alias("d"))
    columns = ["k", "n_rows", "s", "lo", "hi", "d"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [10_000, 3])
def test_heavy_keys_on_either_side(spark, monkeypatch, how, most):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(2, i) for i in range(5)] + [(3, 0), (None, 0)], "k int, a int")
    right = spark.createDataFrame([(2, i) for i in range(50)] + [(1, 0), (1, 1), (4, 0), (None, 1)], "k int, b int")
    got = Counter(map(tuple, skew.skew_join(left, right, "k", 0.2, how).select("k", "a", "b").collect()))
    assert got == Counter(map(tuple, left.join(right, "k", how).select("k", "a", "b").collect()))
