from quern.operators import skew


def test_hot_keys_join_like_others(spark):
    big = spark.createDataFrame([(i % 3 if i % 4 else 7, i) for i in range(400)] + [(None, 1)], "k long, v long")
    small = spark.createDataFrame([(0, "a"), (7, "b"), (7, "c"), (9, "d")], "k long, w string")
    hot = skew.hot_keys(big.groupBy("k").count(), ["k"], n="count", hot_rows=50, most=10)
    assert {(r.k, r.salts) for r in hot.collect()} == {(0, 2), (1, 2), (2, 2), (7, 2)}
    for how in ("inner", "left", "left_semi"):
        got = skew.spread_join(big, small, ["k"], hot, ["v"], how)
        want = big.join(small, "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_number_of_hot_keys_is_bounded(spark):
    counts = spark.range(1000).selectExpr("id AS k", "100L AS n")
    assert skew.hot_keys(counts, ["k"], hot_rows=10, most=50).count() <= 50
    assert skew.hot_keys(counts.limit(0), ["k"]).count() == 0
