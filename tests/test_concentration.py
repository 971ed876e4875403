from undertow.operators import concentration as co


def frame(spark, rows):
    return spark.createDataFrame([(k, float(d)) for k, d in rows], "k string, dollars double")


def test_two_equal_shares(spark):
    assert co.hhi(frame(spark, [("a", 50), ("b", 50), (None, 10), ("c", -4)]), "k").first().hhi == 5000


def test_gini_and_ratios(spark):
    r = co.concentration(frame(spark, [(c, 1) for c in "abcd"]), "k").first()
    assert (r.gini, r.c4, r.hhi_class, r.equivalent_firms) == (0, 100, "high", 4)


def test_split(spark):
    d = spark.createDataFrame([(30.0, ["AWS", "Azure"], "X"), (10.0, ["AWS"], "X"), (5.0, [], "X"), (1.0, None, "Y")], "dollars double, platform_mentions array<string>, final_platform string")
    assert sorted((r.platform_for_analysis, r.dollars_split) for r in co.expand_mentions(d).collect()) == [("AWS", 10.0), ("AWS", 15.0), ("Azure", 15.0), ("X", 5.0), ("Y", 1.0)]


def test_jackknife_equals_refit(spark):
    rows = [("p1", "a", 3.0), ("p1", "b", 1.0), ("p2", "a", 2.0), ("p3", "c", 5.0), ("p3", "a", 1.0)]
    d = spark.createDataFrame(rows, "original_prime_id string, k string, dollars double")
    got = {r.original_prime_id: r.hhi for r in co.jackknife_hhi(d, "k").collect()}
    for p in got:
        assert abs(got[p] - co.hhi(d.filter(d.original_prime_id != p), "k").first().hhi) < 1e-9


def test_empty(spark):
    assert co.concentration(frame(spark, [("a", 1)]).filter("false"), "k").first().hhi is None
