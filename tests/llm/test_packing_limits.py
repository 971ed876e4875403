"""Loss counts of instruction data, limits that bind, and strings that the tokenizer's file gives ids of their own."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from undertow.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequences(pieces):
    out = {}
    for p in pieces:
        out.setdefault(p.sequence_id, []).append(p)
    return out


@pytest.mark.parametrize("limits", [packing.Limits(100, 5, 30, 16), packing.Limits(64, 3, 64, 8), packing.Limits(50, 50, 5, 64)])
def test_loss_of_replies_under_all_limits(spark, limits):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "straße", "日本", "x9"]) for _ in range(n))
    rows = [(i, words(rng.randrange(60)), words(rng.randrange(1, 25)) if i % 7 else None, "s") for i in range(60)] + [(None, None, "lone", "s"), (5, words(400), words(300), "t"), (6, "p", "r", "u"), (6, "p", "r", "u")]
    d = spark.createDataFrame(rows, "doc_id long, question string, text string, length string")
    pieces = packing.pack_documents(d, PATH, limits=limits, prompt="question").collect()
    t = Tokenizer.from_file(PATH)
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids
    want = {}
    for i, q, a, _ in rows:
        own = want.setdefault(i, [0, 0])
        own[0] += len(ids(q)) + len(ids(a)) + 1
        own[1] += len(ids(a)) + 1
    got = {}
    for p in pieces:
        own = got.setdefault(p.doc_id, [0, 0])
        own[0] += p.length
        own[1] += p.loss_tokens
    assert got == want
    fullest = [0, 0, 0]
    for own in sequences(pieces).values():
        sums = [sum(p.length for p in own), len(own), sum(p.loss_tokens for p in own)]
        assert all(x <= m for x, m in zip(sums, (limits.max_tokens, limits.max_segments, limits.max_loss_tokens), strict=True))
        fullest = [max(x, y) for x, y in zip(fullest, sums, strict=True)]
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    assert fullest[1] == limits.max_segments or fullest[2] == limits.max_loss_tokens


def test_special_strings_as_the_library_gives_them(spark):
    texts = ["a <|endoftext|> b", "x<|startoftext|>y.", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<| endoftext |>", "<|endoftext|>.", "", None, "w<|endoftext|>!"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(PATH)
    got = {p.doc_id: (p.doc_tokens, p.ids_crc32) for p in packing.pack_documents(d, PATH).collect()}
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}
    assert any(49407 in x for x in ids)
