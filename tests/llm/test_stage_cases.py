"""Odd inputs of the stages: clashing and extra columns, nulls, empty tables, repeated rows that differ elsewhere, the join beside
the broadcast, and pairs that SimHash alone can't see."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from undertow.llm import nearcopies, stages, toxicity  # noqa: E402

NAMES = ["d", "k", "own", "uid", "key", "bitmap", "stay", "n", "doc", "row_key", "node", "_d", "__n"]
SCHEMA = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, *([x] * len(NAMES))) for i, t, x in rows], SCHEMA)


def write_labels(spark, path):
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_clashing_columns_pass_through_every_stage(spark, tmp_path):
    write_labels(spark, tmp_path)
    own = [(i, f"vile {i}" if i % 5 == 0 else " ".join(f"w{i}x{k}" for k in range(30)), "x") for i in range(50)]
    d = docs(spark, [*own, (60, None, "y"), (61, "", "y"), (None, "no id", "z"), (3, own[3][1], "other"), (3, own[3][1], "x")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString(), name
        rows = out.collect()
        assert len(rows) > 30 and {r.own for r in rows} <= {"x", "y", "z", "other"}, name
        none = stage(spark, d.filter("false"), str(tmp_path))
        assert none.columns == d.columns and none.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() >= d.count()


def test_which_of_repeated_rows_stays_is_settled(spark):
    rows = [(7, "same words in this text here", x) for x in "abcabc"]
    left = {tuple(r) for order in (rows, rows[::-1]) for r in stages.dedup_near(spark, docs(spark, order).repartition(3), "").collect()}
    assert len(left) == 1


def similar(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base), "")]
    for i in range(1, 12):  # similarity to the first from 0.82 to 0.97, so that fingerprints differ in many bits
        other = list(base)
        for at in range(i % 4 + 1):
            other[9 + 40 * at + i] = f"new{i}x{at}"
        rows.append((i, " ".join(other), ""))
    return docs(spark, [*rows, (50, "quite another text with words of its own", "")])


@pytest.mark.parametrize("how", [nearcopies.Near(), nearcopies.Near(max_keys=0)])
def test_pairs_beyond_the_fingerprints(spark, how):
    got = sorted(r.doc_id for r in nearcopies.representatives(similar(spark), how).collect())
    assert got == [0, 50]


def test_the_run_leaves_no_folder(spark, tmp_path):
    import os

    write_labels(spark, tmp_path)
    docs(spark, [(i, " ".join(f"w{i}x{k}" for k in range(30)), "x") for i in range(50)]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [x for x in os.listdir(shared) if x.startswith("pipeline-")]
    assert toxicity.Toxicity().threshold == 0.7
