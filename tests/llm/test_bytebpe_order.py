"""The same ids whatever order rows come in, when a task's rows are shuffled between evaluations; decoding by a join."""

import base64

import numpy as np
import pyarrow as pa
import pytest
import zstandard

public_tokenizers = pytest.importorskip("public_tokenizers")

import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from undertow.llm import bytebpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows():
    return [(i, " ".join(f"w{(i * 7 + k * k) % 97}x" for k in range(i % 40)) + "é 日本" * (i % 3)) for i in range(300)] + [(1, None), (2, ""), (None, "no id"), (7, "one " * 20_000)]


def test_rows_in_another_order_at_each_evaluation(spark):
    """A stage before it hands on a partition's rows in an order of its own each time, as after a shuffle or a lost executor."""
    import random

    def stirred(batches):
        own = pa.Table.from_batches(list(batches))
        order = list(range(own.num_rows))
        random.SystemRandom().shuffle(order)
        yield from own.take(pa.array(order, pa.int64())).to_batches()

    d = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3).mapInArrow(stirred, "doc_id long, text string")
    how = bytebpe.ByteBPE(PATH, public_tokenizers.PATTERN, block_bytes=3000)
    enc = plain()
    want = sorted((str(i), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows())
    for _ in range(2):
        assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in bytebpe.encode_decode(d, how).collect()) == want


def test_the_same_blocks_from_rows_in_any_order():
    how = bytebpe.ByteBPE(PATH, public_tokenizers.PATTERN)
    import unittest.mock as mock

    def split(own):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([t or "" for _, t in own])], names=["doc_id", "text"])
        with mock.patch.object(bytebpe.TaskContext, "get", return_value=mock.Mock(partitionId=lambda: 0)):
            out = [r for b in bytebpe._split_rows(how, 8, iter([batch])) for r in b.to_pylist()]
        # documents that are compressed together come apart again: which ones are is the rows' order alone
        places = []
        for r in out:
            if r["bucket"] == bytebpe.PLACES:
                raw = zstandard.ZstdDecompressor().decompress(r["data"])
                ends = np.cumsum(np.frombuffer(raw, "<u4", r["n"]))[:-1].astype(np.int64)
                places += [(str(i), p.tolist()) for i, p in zip(r["docs"], np.split(bytebpe._numbers(raw, 4 * r["n"]), ends), strict=True)]
        assert len(places) == len(own)
        return sorted(str(r) for r in out if r["bucket"] != bytebpe.PLACES), sorted(places)

    own = rows()
    assert split(own) == split(own[::-1])


def test_decode_joins_the_token_table(spark):
    enc = plain()
    texts = ["a bc  d\n", "日本 №5 x²", "", "don't"]
    own = [(i, enc.encode_ordinary(t)) for i, t in enumerate(texts)] + [(1, enc.encode_ordinary("again")), (None, enc.encode_ordinary("null")), (9, None)]
    d = spark.createDataFrame(own, "doc_id long, ids array<long>").withColumn("token", F.lit("clash"))
    got = sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in bytebpe.decode(d, bytebpe.token_table(spark, PATH)).collect())
    assert got == sorted([*((str(i), t) for i, t in enumerate(texts)), ("1", "again"), ("None", "null"), ("9", "")])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.encode_decode(none, bytebpe.ByteBPE(PATH, public_tokenizers.PATTERN)).count() == 0
