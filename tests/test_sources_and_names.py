import math
import random

import pytest
from pyspark.sql import functions as F

from undertow.functions.names import humanise, short_name
from undertow.operators import exposure as ex
from undertow.operators import validation as va
from undertow.sources import files


def test_short_names(spark):
    want = {
        "ACME HOLDINGS, L.L.C., INC.": "Acme Holdings", "BANK OF THE WEST CORP": "Bank of the West", "IBM CORPORATION": "IBM", "THE LLC GROUP": "THE LLC Group", "INC": "INC",
        "O'BRIEN-SMITH PROFESSIONAL SERVICES LLC": "O'Brien-Smith", "  ": "",
    }
    df = spark.createDataFrame([(k,) for k in [*want, None]], "n string").select("n", short_name("n").alias("s"))
    assert {r.n: r.s for r in df.collect()} == {**want, None: None}


def test_humanise(spark):
    want = {"AT&T GOVERNMENT (USA)": "AT&T Government (USA)", "TEKSYSTEMS, LLC": "TEKsystems, LLC", "SALESFORCE.COM": "Salesforce.com"}
    df = spark.createDataFrame([(k, False) for k in want] + [("aWS x", True), ("aWS x", None)], "n string, p boolean").select("n", "p", humanise("n", F.col("p")).alias("h"))
    got = {(r.n, r.p): r.h for r in df.collect()}
    assert got == {(k, False): v for k, v in want.items()} | {("aWS x", True): "aWS x", ("aWS x", None): "Aws X"}


def test_read_awards(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Id,Amount,Date,Text\n1,"$1,234.5",2020-10-01,"two\nlines ""q"""\n2,x,never,\n'.encode())
    df = files.read_awards(spark, str(tmp_path / "a.csv"), {"Id": "award_id", "Amount": "dollars", "Date": "effective_date", "Text": "description"})
    a, b = df.orderBy("award_id").collect()
    assert (a.award_id, a.dollars, str(a.effective_date), a.description) == ("1", 1234.5, "2020-10-01", 'two\nlines "q"')
    assert (b.dollars, b.effective_date, b.description) == (None, None, None)


def test_read_ratings(spark, tmp_path):
    (tmp_path / "r.csv").write_text("u,l\n 1 ,NA\n2,other\n3,\n4,yes \n")
    got = files.read_ratings(spark, str(tmp_path / "r.csv"), "x", "u", "l", ["yes", "NA"]).collect()
    assert {r.unit_id: r.label for r in got} == {"1": "NA", "2": "Unspecified", "3": None, "4": "yes"}


def test_chunks(spark, tmp_path):
    path = str(tmp_path / "c")
    files.write_chunks(spark.range(100), path, 4, "id")
    assert files.read_chunks(spark, path, [0, 1, 2, 3]).count() == 100
    with pytest.raises(FileNotFoundError, match="4"):
        files.read_chunks(spark, path, [0, 4])
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_table(spark.range(1), path)
    files.write_table(spark.range(1), path, overwrite=True)


def test_power_simulation(spark):
    assert va.sample_grid(10, 1000, 3) == [10, 100, 1000]
    rows = {(r.true_alpha, r.n_items): r for r in va.power_simulation(spark, [0.5, 0.8], [20, 300], 3, 120, 5).collect()}
    for (a, n), r in rows.items():
        assert abs(r["mean"] - a) < 0.05 and r.low < a < r.high and r.n_defined == 120
    assert rows[0.5, 300].high - rows[0.5, 300].low < rows[0.5, 20].high - rows[0.5, 20].low
    one = va.power_simulation(spark, [1.0], [2], 1, 5, 5).collect()[0]
    assert one.n_defined == 0 and one["mean"] is None


def test_layout_is_the_banded_one(spark):
    rnd = random.Random(3)
    rows = [(f"n{i}", rnd.randint(1, 3), rnd.random() < 0.4) for i in range(40)]
    got = {r.node: (r.x, r.y) for r in ex.annulus_layout(spark.createDataFrame(rows, "node string, d int, v boolean"), "node", "d", "v").collect()}
    inner, before = 0.52, 0
    for seen in (True, False):
        band = sorted([r for r in rows if r[2] == seen], key=lambda r: (r[1], r[0]))
        outer = math.sqrt(inner**2 + len(band) / (math.pi * 27.4))
        for i, r in enumerate(band):
            radius = math.sqrt(inner**2 + (i + 0.5) / len(band) * (outer**2 - inner**2))
            turn = (before + i) * math.pi * (3 - math.sqrt(5))
            assert got[r[0]] == pytest.approx((radius * math.cos(turn), radius * math.sin(turn)))
        inner, before = outer, before + len(band)
