import numpy as np

from undertow.operators import persistence as pe
from undertow.operators import validation as va

# K churns by contractor under one platform, L keeps both, M skips a year, N returns to a platform by another contractor
ROWS = [
    ("K", 2020, "c1", "east"), ("K", 2021, "c2", "east"), ("K", 2022, "c3", "east"), ("K", 2022, "c2", "west"),
    ("L", 2020, "c4", "west"), ("L", 2021, "c4", "west"), ("L", 2021, "c4", "west"),
    ("M", 2020, "c1", "east"), ("M", 2022, "c1", "east"),
    ("N", 2021, "c5", "east"), ("N", 2021, "c6", "west"), ("N", 2022, "c7", "west"),
]


def test_retention_and_ratio(spark):
    r = spark.createDataFrame(ROWS, "buyer string, fiscal_year int, naive string, unclouded string")
    assert sorted(tuple(x) for x in pe.retention(r, "naive").collect()) == [("K", 2, 1), ("L", 1, 1), ("M", 0, 0), ("N", 2, 0)]
    assert sorted(tuple(x) for x in pe.retention(r, "unclouded").collect()) == [("K", 2, 2), ("L", 1, 1), ("M", 0, 0), ("N", 2, 1)]
    p = pe.persistence(r, "naive", "unclouded").first()
    assert (p.c_naive, p.c_unclouded, p.n_buyers) == (0.4, 0.8, 3) and abs(p.ratio - 2) < 1e-12


def test_shuffle_keeps_each_years_keys(spark):
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(ROWS)], "record_id int, buyer string, fiscal_year int, naive string, unclouded string")
    s = pe.shuffle_within_year(r, "naive", 3)
    key = lambda d: sorted((x.fiscal_year, x.naive) for x in d.collect())
    assert key(s) == key(r)


def test_bca_of_a_symmetric_sample():
    draws = np.linspace(-1, 1, 10001)
    low, high = pe.bca_interval(0.0, draws, np.array([-1.0, 0, 1.0]))
    assert abs(low + 0.95) < 0.01 and abs(high - 0.95) < 0.01


def test_alpha_of_two_raters(spark):
    rows = [(u, r, v) for u, (a, b) in enumerate([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")]) for r, v in (("a", a), ("b", b))]
    d = spark.createDataFrame(rows + [(9, "a", "x")], "unit_id int, rater string, label string")
    # closed form: 1 - (n - 1) * disagreements / (n^2 - sum of squared label counts)
    assert abs(va.krippendorff_alpha(d).first().alpha - (1 - 7 * 2 / (64 - 9 - 25))) < 1e-12


def test_strata_exclude_drawn_rows(spark):
    from pyspark.sql import functions as F

    d = spark.range(30)
    s = va.stratified_sample(d, [("low", F.col("id") < 10, 5), ("all", F.lit(True), 20)], "id", 1).collect()
    assert len(s) == 25 and len({r.id for r in s}) == 25
