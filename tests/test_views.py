"""Views and reports on rows with nulls, ties and repeats; the registered queries have SQL twins."""

from pyspark.sql import functions as F

from undertow.operators import views as vi


def test_keys_masks_and_recodes(spark):
    names = "contractor string, final_platform string, attribution_method string, is_cloud boolean, dollars double, fiscal_year int"
    rows = [("a", "P", "phase1_direct", True, 1.0, 2020), ("b", "P", None, True, 1.0, 2020), ("c", "Q", "phase3_pattern", None, 1.0, 2020), ("d", "Q", "phase2_description", True, -1.0, 2020), ("e", "Q", "phase2_description", True, 1.0, 2031)]
    got = vi.view_keys(spark.createDataFrame(rows, names), 2019, 2021).collect()
    assert sorted((r.naive, r.unclouded, r.key_source) for r in got) == [("a", "P", "attributed"), ("b", "b", "contractor")]
    d = spark.createDataFrame([("Big Fish", "x"), (None, "y"), ("cat", None)], "n string, l string")
    got = d.select(vi.name_contains("n", ["fish", "dog"]).alias("m"), vi.recode("l", {"x": "z"}).alias("r"), vi.recode_from(F.col("l"), vi.name_contains("n", ["fish"]), F.lit(None).cast("boolean"), "w").alias("f")).collect()
    assert [tuple(r) for r in got] == [(True, "z", "x"), (False, "y", "y"), (False, None, None)]


def test_ratings_parents_and_repeats(spark):
    r = spark.createDataFrame([(1, "a", "x", "high"), (1, "a", "w", "high"), (1, "b", "y", None), (2, "b", None, "low")], "unit_id int, rater string, label string, confidence string")
    assert sorted(map(tuple, vi.wide(r, ["a", "b"]).collect())) == [(1, "w", "y"), (2, None, None)]
    assert vi.rating_filter(r, confidence=["high", "low"], drop=["x"]).count() == 2 and vi.rating_filter(r, units=r.filter("rater = 'a'")).count() == 3
    assert [(x.unit_id, x.n) for x in vi.repeated(r, "unit_id").collect()] == [(1, 3)]
    p = spark.createDataFrame([("u", "u"), ("u", "t"), ("u", "s"), ("v", None), (None, "q")], "uei string, parent_uei string")
    assert [tuple(x) for x in vi.parent_lookup(p).collect()] == [("u", "s")]
    assert sorted((x.uei or "") for x in vi.with_parent(p.select("uei"), "uei", vi.parent_lookup(p)).collect()) == ["", "s", "s", "s", "v"]


def test_empty_tables_and_deltas(spark):
    none = spark.createDataFrame([], "contractor string, dollars double, is_cloud boolean, attribution_method string, fiscal_year int, record_type string, explicit_cloud_mention boolean, llm_classification string")
    assert vi.method_sums(none).first().cloud == 0 and vi.label_conflicts(none).first().dollars == 0 and vi.year_profile(none).count() == 0 and vi.evidence(none).count() == 0
    s = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 5.0), ("b", 2, 7.0), ("c", 1, 2.0)], "k string, w int, p double")
    assert sorted(map(tuple, vi.window_delta(s, "k", "w", "p").collect())) == [("a", 10.0, 5.0, -5.0, False), ("b", 0.0, 7.0, 7.0, True), ("c", 2.0, 0.0, -2.0, False)]
    c = spark.createDataFrame([("x", 4, 2, 4, 3), ("y", 6, 3, 6, 6), ("z", 0, 0, 0, 0)], "buyer string, na long, nr long, ua long, ur long")
    assert sorted((r.buyer, r.c_naive, r.c_unclouded) for r in vi.leave_one_out(c).collect()) == [("x", 0.5, 1.0), ("y", 0.5, 0.75)]
