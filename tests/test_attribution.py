from undertow.operators import attribution as at

BANK = {"AWS": [r"\bAWS\b"], "Google Cloud": [r"\bBigQuery\b", r"\bBigQuery\b"], "Azure": [r"\bAzure\b"], "Multi-cloud": [r"multi-?cloud"]}


def test_regex_classification(spark):
    rows = [(0, "aws hosting", None), (1, "bigquery", None), (2, "aws and azure", None), (3, "multi-cloud", None), (4, "lambda calculus", None), (5, None, "AWS reseller")]
    d = at.regex_classify(spark.createDataFrame(rows, "i int, description string, contractor_name string"), BANK, [r"cloud hosting"])
    got = [(r.regex_is_cloud, r.regex_platforms, r.regex_confidence) for r in d.orderBy("i").collect()]
    assert got == [(True, "AWS", "High"), (True, "Google Cloud", "Medium"), (True, "Multi-cloud", "Medium"), (True, "Multi-cloud", "Low"), (False, None, "Low"), (True, "AWS", "Medium")]


def test_learner(spark):
    rows = [("a", "AWS", 1.0)] * 9 + [("a", "Azure", 1.0)] + [("b", "AWS", 1.0)] * 4 + [("c", "AWS", 1.0)] * 5 + [("c", "Azure", 1.0)] * 5
    got = at.learn_patterns(spark.createDataFrame(rows, "contractor string, platform string, dollars double")).collect()
    assert [(r.contractor, r.learned_platform, r.share, r.evidence) for r in got] == [("a", "AWS", 0.9, 10.0)]


def test_entities(spark):
    d = spark.createDataFrame([("Microsoft Corporation",), ("THE ORACLE CORPORATION GROUP",), ("ibm federal",), ("Amazonia",), (None,)], "n string")
    assert [r[0] for r in d.select(at.entity_platform("n")).collect()] == ["Azure", "Oracle Cloud", "IBM Cloud", None, None]


def test_labels(spark):
    rows = ['{"classification": "cloud-dependent", "platform": "Amazon", "confidence": "sure"}', 'x "classification": "non-cloud", "platform": "Q" ...', "no"]
    got = [tuple(r[0])[:3] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(at.parse_label("r")).collect()]
    assert got == [("cloud-dependent", "AWS", "low"), ("non-cloud", "Q", "low"), ("error", "error", "low")]
