import datetime as dt

from pyspark.sql import functions as F

from undertow.functions import scalar
from undertow.operators import prep

PRIME = "award_id string, uei string, contractor_name string, parent_uei string, dollars double, effective_date date, description string, _ord long"
SUB = "subaward_id string, sub_uei string, sub_name string, dollars double, description string"
DAY = dt.date(2020, 10, 1)


def prime(spark, *rows):
    return spark.createDataFrame([(i, "U" + i, "N" + i, None, d, DAY, "prime text", n) for n, (i, d) in enumerate(rows)], PRIME)


def merged(spark, primes, subs):
    s = spark.createDataFrame(subs, SUB)
    return prep.merge_awards(primes, prep.link_subawards(s, primes))


def test_decomposition_conserves_dollars(spark):
    p = prime(spark, ("A_1", 100.0), ("B_1", 100.0), ("C_1", 100.0), ("D_1", 100.005), ("E_1", -10.0))
    subs = [("B_1_x", "S", "s", 30.0, None), ("B_1_y", None, "only name", 20.0, "own"), ("C_1_x", "S", "s", 150.0, None), ("C_1_y", "S", "s", 50.0, None), ("D_1_x", "S", "s", 100.0, None), ("E_1_x", "S", "s", 20.0, None)]
    rows = {(r.original_prime_id, r.record_type, r.contractor, round(r.dollars, 3)) for r in merged(spark, p, subs).collect()}
    assert rows == {
        ("A_1", "prime_no_subs", "UA_1", 100.0), ("B_1", "prime_retained", "UB_1", 50.0), ("B_1", "subcontract", "S", 30.0), ("B_1", "subcontract", "only name", 20.0),
        ("C_1", "subcontract", "S", 75.0), ("C_1", "subcontract", "S", 25.0), ("D_1", "subcontract", "S", 100.0), ("E_1", "subcontract", "S", -10.0),
    }


def test_sub_descriptions_fall_back_to_the_primes(spark):
    rows = merged(spark, prime(spark, ("B_1", 100.0)), [("B_1_x", "S", "s", 30.0, None)]).filter("record_type = 'subcontract'").collect()
    assert rows[0].description == "prime text" and rows[0].fiscal_year == 2021 and rows[0].prime_contractor == "UB_1"


def test_prefix_link_prefers_six_parts_then_the_longest(spark):
    p = prime(spark, ("A_B_C_D_E_F", 1.0), ("A_B_C_D_E_F_G", 1.0), ("A_B", 1.0))
    subs = spark.createDataFrame([("A_B_C_D_E_F_G", None, None, 1.0, None), ("A_B_X", None, None, 1.0, None), ("A", None, None, 1.0, None), ("Q_R", None, None, 1.0, None)], SUB)
    got = {r.subaward_id: r.prime_id for r in prep.link_subawards(subs, p).collect()}
    assert got == {"A_B_C_D_E_F_G": "A_B_C_D_E_F", "A_B_X": "A_B", "A": None, "Q_R": None}


def test_dedupe(spark):
    rows = [("X", None, "n", None, 5.0, DAY, "aa", 0), ("X", "U2", "n", None, 7.0, DAY, "bbb", 1), ("X", "U3", "n", None, 1.0, None, "ccc", 2)]
    r = prep.dedupe_awards(spark.createDataFrame(rows, PRIME), first=("uei",)).collect()
    assert [(x.dollars, x.description, x.uei, x.fiscal_year) for x in r] == [(7.0, "bbb", "U2", 2021)]


def test_keywords(spark):
    rows = ["laptop and printer", "laptop software", "laptop", "xyz", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, description string")
    assert [r.keyword_class for r in prep.keyword_class(d).orderBy("i").collect()] == ["hardware", "service", "hardware_weak", "unknown", "unknown"]


def test_scalars(spark):
    d = spark.createDataFrame([("$1,234.5", "2020-09-30"), ("x", "2020-10-01"), (None, "bad")], "m string, d string")
    r = d.select(scalar.parse_currency("m").alias("m"), scalar.fiscal_year(scalar.coerce_date("d")).alias("y")).collect()
    assert [(x.m, x.y) for x in r] == [(1234.5, 2020), (None, 2021), (None, None)]


def test_merge_of_nothing(spark):
    p = prime(spark, ("A", 1.0)).filter("false")
    assert merged(spark, p, [("A_B", "S", "s", 1.0, None)]).count() == 0
    assert prep.dollar_integrity(p.withColumn("dollars", F.col("dollars")), p).first().ok
