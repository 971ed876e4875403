"""Texts that pass the base rule, but repeat too much: the suffix array's verdict alone rejects them."""

import pytest

pytest.importorskip("public_tokenizers")

from undertow.llm import quality  # noqa: E402


def test_repeats_decide(spark):
    fresh = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    passage, long = fresh("p", 10), fresh("q", 60)
    texts = {
        1: fresh("a", 100),
        2: " ".join([passage, fresh("a", 80), passage]),  # 20 of 100 words covered
        3: " ".join([passage, fresh("a", 180), passage]),  # 20 of 200
        4: " ".join([long, fresh("a", 1880), long]),  # 120 of 2,000, but 60 at once
        5: fresh("a", 5),
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.n_covered_words, r.longest_repeat, r.kept) for r in quality.quality_rules(rows).collect()}
    assert got == {1: (False, 0, 0, True), 2: (False, 20, 10, False), 3: (False, 20, 10, True), 4: (False, 120, 60, False), 5: (True, 0, 0, False)}
