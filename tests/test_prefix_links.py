from undertow.operators import prep


def test_shared_first_parts_are_not_sought(spark):
    primes = spark.range(60).selectExpr("concat('CONT_AWD_', id, '_X_Y_Z') AS award_id")
    subs = spark.range(60).selectExpr("concat('CONT_AWD_', id, '_X_Y_Z_', id % 4, '_7') AS subaward_id")
    found = prep.prefix_candidates(subs, primes)
    assert found.count() == 60 and found.groupBy("prime_id").count().agg({"count": "max"}).first()[0] == 1
    assert prep.link_subawards(subs, primes).filter("prime_id = substring_index(subaward_id, '_', 6)").count() == 60


def test_six_parts_first_then_the_longest(spark):
    primes = spark.createDataFrame([("a_b",), ("a_b",), ("a_b_c_d_e_f",), ("a_b_c_d_e_f_g",), ("q_r_s",), (None,)], "award_id string")
    subs = spark.createDataFrame([(x,) for x in ("a_b_c_d_e_f_g_h", "a_b_x", "a_b_c_d_e_x_y", "q_r_s_t", "q_r", "a", None, "a_b")], "subaward_id string")
    got = {r.subaward_id: r.prime_id for r in prep.link_subawards(subs, primes).collect()}
    assert got == {"a_b_c_d_e_f_g_h": "a_b_c_d_e_f", "a_b_x": "a_b", "a_b_c_d_e_x_y": "a_b", "q_r_s_t": "q_r_s", "q_r": None, "a": None, None: None, "a_b": "a_b"}
    none = prep.link_subawards(subs, primes.limit(0))
    assert none.count() == 8 and none.filter("prime_id is not null").count() == 0
