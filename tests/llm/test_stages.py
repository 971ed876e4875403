"""Stages of the corpus pipeline and the whole of it, on small fixtures against plain versions."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from undertow.llm import nearcopies, stages, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def near_corpus(seed=7):
    """Texts, copies with a few words changed (similarities on both sides of 0.8), exact copies, empty ones."""
    rng = random.Random(seed)
    out = []
    for b in range(12):
        base = words(rng, rng.randrange(60, 300))
        out.append(base)
        for changes in range(1, 7):
            other = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * changes // 200)):
                other[at] = f"new{rng.randrange(10**6)}"
            out.append(other)
        out.append(base + words(rng, len(base) // 6))
    rows = [(i, " ".join(x)) for i, x in enumerate(out)]
    return [*rows, (900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, rows[0][1]), (904, rows[0][1]), (None, rows[9][1])]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_near(rows):
    """Ids that stay, and the similarities of unequal pairs that are linked."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    linked = []
    for i in range(len(rows)):
        for j in range(i):
            if (s := jaccard(sets[i], sets[j])) >= 0.8:
                linked.append(s)
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    stay = {}
    for (i, _), g in zip(rows, group, strict=True):
        key = (i is None, i)
        stay[g] = min(stay.get(g, key), key)
    return sorted(str(k[1]) for k in stay.values()), [s for s in linked if s < 1]


def test_near_copies_of_similarity_0_8_go(spark):
    rows = near_corpus()
    want, linked = plain_near(rows)
    assert sum(s <= 0.95 for s in linked) > 10
    assert sorted(str(r.doc_id) for r in stages.dedup_near(spark, docs(spark, rows), "").collect()) == want


@pytest.mark.parametrize("sample", [1, 16])
def test_common_shingles_change_no_result(spark, sample):
    rng = random.Random(2)
    passage = " ".join(words(rng, 30))
    rows = [(i, f"{passage} {t}") for i, t in near_corpus(11) if t]
    want, _ = plain_near(rows)
    got = nearcopies.representatives(docs(spark, rows), nearcopies.Near(sample=sample)).collect()
    assert sorted(str(r.doc_id) for r in got) == want


def plain_lines(rows):
    """Texts without lines that ten documents share, but for the first by doc_id and position."""
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    holders, first = {}, {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            holders.setdefault(key(x), set()).add(i)
            first[key(x)] = min(first.get(key(x), (i, k)), (i, k))
    goes = lambda i, k, x: key(x) and len(holders[key(x)]) >= 10 and first[key(x)] != (i, k)
    return sorted((i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if not goes(i, k, x))) for i, t in rows)


def copied_corpus():
    rng = random.Random(4)
    twelve = "\n".join(" ".join(words(rng, 12)) for _ in range(6))
    two = "\n".join(" ".join(words(rng, 12)) for _ in range(6))
    rows = [(100 + i, twelve) for i in range(12)] + [(200 + i, two) for i in range(2)]
    rows += [(300 + i, " ".join(words(rng, 40)) + "\n  A common LINE \n" + " ".join(words(rng, 40))) for i in range(15)]
    return [*rows, (400, None), (401, ""), (100, twelve)], twelve, two


def test_line_dedup_keeps_first_occurrences(spark):
    rows, twelve, _ = copied_corpus()
    got = sorted((r.doc_id, r.text) for r in stages.dedup_lines(spark, docs(spark, rows), "").collect())
    assert got == plain_lines(rows)
    assert [i for i, t in got if t == twelve] == [100, 100]


def test_a_text_of_twelve_copies_leaves_the_pipeline_once(spark):
    rows, twelve, two = copied_corpus()
    left = stages.dedup_near(spark, stages.dedup_lines(spark, docs(spark, rows), ""), "").collect()
    assert [r.doc_id for r in left if r.text == twelve] == [100] and [r.doc_id for r in left if r.text == two] == [200]


def test_other_stages_and_the_whole_run(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows, _, _ = copied_corpus()
    rows += [(1000 + i, t) for i, t in near_corpus() if i is not None]
    bad = [(2000 + i, "you rotten fool " + " ".join(words(rng, 3))) for i in range(40)]
    fine = [(3000 + i, "a fine day " + " ".join(words(rng, 3))) for i in range(40)]
    rows += bad + fine
    d = str(tmp_path)
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in fine]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    table = spark.read.parquet(f"{d}/documents.parquet")
    clean = stages.drop_toxic(spark, table, d)
    judged = {r.doc_id for r in toxicity.classify(table, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 0").collect()}
    assert {r.doc_id for r in clean.collect()} == judged and not judged & {i for i, _ in bad} and judged >= {i for i, _ in fine}

    # the stages that follow, each by its plain version
    own = [(r.doc_id, r.text) for r in clean.collect()]
    lines_left = plain_lines(own)
    stay, _ = plain_near(lines_left)
    left = [(i, t) for i, t in dict(sorted(lines_left)).items() if str(i) in stay]
    count = {}
    for _, t in left:
        b = t.encode()
        for s in range(len(b) - 199):
            count[b[s : s + 200]] = count.get(b[s : s + 200], 0) + 1
    want = []
    for i, t in left:
        b = t.encode()
        gone = set()
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone.update(range(s, s + 200))
        want.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode()))
    got = stages.dedup_substrings(spark, docs(spark, left), d).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)

    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}
    packed = {}
    for r in corpus_pipeline.run(spark, d).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == size
