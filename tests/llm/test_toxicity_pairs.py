"""The counterfactual penalty: pairs in all languages, less movement on neutral mentions, one row for a doc_id, odd labels."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from undertow.llm import toxicity  # noqa: E402
from undertow.llm.toxicity import Toxicity  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], "doc_id long, text string, label string, score int, row_key string")


def biased(spark, n=300):
    """Toxic sentences name one group, clean ones another; insults are the better reason."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        group = "gay" if bad and rng.random() < 0.9 else "straight" if rng.random() < 0.5 else ""
        insult = rng.choice(["rotten", "vile", "filthy"]) if bad and rng.random() < 0.7 else ""
        rows.append((i, f"they {group} {insult} folks said {rng.choice(['one', 'two', 'three'])} things"))
        labels.append((i, 1, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, LABELS)


def mention(model):
    at = model.weights.nonzero()[0]
    score = toxicity.Scorer(at, model.weights[at], model.intercept, model.how)
    return score(b"my gay friend said things") - score(b"my straight friend said things"), score(b"you vile one") - score(b"you one")


def test_a_neutral_mention_moves_less_with_the_penalty(spark):
    d, labels = biased(spark)
    plain = toxicity.fit(d, labels, Toxicity(swap_penalty=0.0, l1=1e-3))
    fair = toxicity.fit(d, labels, Toxicity(swap_penalty=1.0, l1=1e-3))
    (bias, insult), (left, still) = mention(plain), mention(fair)
    assert bias > 0.3 and abs(left) < bias / 3
    assert insult > 0.1 and still > 3 * abs(left)
    assert fair.pairs[True, "en"] > 100


def test_pairs_in_every_language(spark):
    named = {"en": "a woman spoke", "de": "die frauen sprachen", "fr": "un musulman parle", "es": "los judíos hablan"}
    rows = [(i, list(named.values())[i % 4] + (" vile" if i % 8 < 4 else "")) for i in range(200)] + [(1000 + i, f"nobody {i}") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, int("vile" in t)) for i, t in rows], LABELS)
    pairs = toxicity.fit(docs(spark, rows), labels).pairs
    assert all(pairs[True, lang] > 10 for lang in named) and all(pairs[False, lang] > 0 for lang in named)
    with pytest.raises(ValueError, match="no counterfactual pairs"):
        toxicity.fit(docs(spark, rows), labels, Toxicity(identity_terms={}))


def test_swaps_change_every_term_and_nothing_else():
    swap = toxicity.Swapper(toxicity.IDENTITY_TERMS)
    for seed in range(40):
        x, y, natural, lang = swap({"the", "woman", "muslims"}, seed)
        assert natural and x == {"the", "woman", "muslims"} and "the" in y and len(y) == 3 and not y & {"woman", "muslims"}
        x, y, natural, _ = swap({"plain"}, seed)
        assert not natural and len(x) == len(y) == 2 and x & y == {"plain"}


def test_one_row_for_a_doc_id_and_odd_labels(spark):
    rows = [(0, "same one")] * 30 + [(0, "other")] * 5 + [(1, None), (7, "vile"), (None, "no id"), (8, "long " * 50_000)]
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (0, 1, None), (1, 1, 0), (7, 1, None), (None, 1, 1), (8, 0, 0)], LABELS)
    got = {r.doc_id: r.label for r in toxicity.training_rows(docs(spark, rows), labels, Toxicity()).collect()}
    assert got == {0: 1, 1: 0, 8: 0}  # none of these ids is held out
    only = toxicity.classify(docs(spark, rows), spark.createDataFrame([(i, 1, 1) for i in (0, 1, 8)], LABELS)).collect()
    assert len(only) == len(rows) and all(r.score > 0.99 for r in only)
    none = toxicity.classify(docs(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(rows) and all(r.score < 1e-6 for r in none)
