"""Small fixtures against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from undertow.llm import bytebpe, chat, fingerprint, html_text, lines, media, packing, quality, substrings, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in texts], SCHEMA)


def corpus(n=40, seed=3):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(99)) for _ in range(60))
    out = []
    for i in range(n):
        t = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 120)))
        if i % 4 == 0:
            t = t[: rng.randrange(len(t))] + passage + t[::-1]
        out.append((i, t + ("\n  Common Line \n" if i % 3 == 0 else "\n")))
    return [*out, (100, None), (101, ""), (102, out[1][1]), (103, "é" * 300), (104, "x " * 3000), (None, "no id"), (5, out[5][1])]


def test_lines(spark):
    rows = corpus()
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_digests(docs(spark, rows)).collect())
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    seen = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(i)
    want = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not (key(x) and len(seen[key(x)]) >= 10)]
        want.append((str(i), len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    assert got == sorted(want)
    assert any(w[2] for w in want)


def test_packing_covers_every_token_once(spark):
    rows = corpus()
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    pieces = packing.pack_documents(docs(spark, rows), path, limits=packing.Limits(64, 4, 64, 16)).collect()
    by_seq, total = {}, 0
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64 and len(own) <= 4
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        own = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert {(s, n, c) for s, n, c, _ in own} == {(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _, _ in own} and all(d == len(ids) for *_, d in own)
    assert sum(p.length for p in pieces) == total


def test_html():
    page = "<body><nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>One\n  two <b>three.<p>Four</article><div id=comments>me too</div><footer>f</footer>"
    assert html_text.main_text(page) == "T & U\nOne two three.\nFour"
    assert html_text.main_text("") == "" and html_text.main_text("plain text") == "plain text"


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "a<|im_end|>\n<\\|b"), (1, 1, "assistant", "r<"), (1, 2, "user", "|q"), (2, 0, "sys\n%0A", None), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.expand(d)).collect()}
    for c in (1, 2, 3):
        own = sorted(r[1:] for r in rows if r[0] == c)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, r, t in own).encode()).hexdigest() and got[c].n_turns == len(own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[c].loss_chars == len(loss)
    assert chat.read_back(chat.expand(d.filter("false"))).count() == 0


def test_byte_bpe_round_trip(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*corpus(12), (200, "a\x1c..\x1c b  \n\n c d　e don't \t"), (201, "日本 №5 x²")]
    got = bytebpe.encode_decode(docs(spark, rows), bytebpe.ByteBPE(path, public_tokenizers.PATTERN, 2000, 4)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_media(spark):
    rows = corpus(12)
    got = media.document_media(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.position == 1 and r.payload_bytes % 576 == 0 for r in got)
    want = sorted(hashlib.sha256(media.padded((t or "").encode())).hexdigest() for _, t in rows)
    assert sorted(r.payload_sha256 for r in got) == want


def test_substrings(spark):
    rows = corpus()
    for how in (substrings.Repeats(), substrings.Repeats(per_group=1), substrings.Repeats(per_group=3, held_bytes=500)):
        got = sorted((str(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeat_digests(docs(spark, rows), how).collect())
        raw = [(i, (t or "").encode()) for i, t in rows]
        count = {}
        for _, b in raw:
            for s in range(len(b) - 199):
                count[b[s : s + 200]] = count.get(b[s : s + 200], 0) + 1
        want = []
        for i, b in raw:
            gone = np.zeros(len(b) + 1, bool)
            for s in range(len(b) - 199):
                if count[b[s : s + 200]] > 1:
                    gone[s : s + 200] = True
            gone = gone[: len(b)]
            kept = bytes(np.frombuffer(b, np.uint8)[~gone])
            want.append((str(i), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
        assert got == sorted(want)


def test_simhash(spark):
    rows = corpus()
    rows += [(300 + i, rows[7][1].strip() + f" tail{i}") for i in range(6)]
    got = {(str(r.doc_id), r.component_id) for r in fingerprint.simhash_components(docs(spark, rows), fingerprint.SimHash(tile=3)).collect()}
    prints = [(i, fingerprint.fingerprint((t or "").encode())) for i, t in rows]
    comp = list(range(len(prints)))
    for _ in comp:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 4:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    small = {}
    for (i, _), c in zip(prints, comp, strict=True):
        if i is not None:
            small[c] = min(small.get(c, i), i)
    assert got == {(str(i), small.get(c)) for (i, _), c in zip(prints, comp, strict=True)}


def test_quality():
    texts = ["", "a " * 40, "one two three four five six seven eight nine " * 2 + "x", " ".join(map(str, range(30)))]
    repeat, covered, longest = quality.repetition([t.encode().split() for t in texts])
    assert repeat.tolist() == [0, 40, 18, 0] and covered.tolist() == [0, 40, 18, 0] and longest.tolist() == [0, 39, 9, 0]


def test_toxicity_and_empty_tables(spark):
    rows = [(i, "you rotten fool" if i % 3 == 0 else "a fine day") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(docs(spark, [*rows, (500, None)]), labels, toxicity.Toxicity(l1=1e-4)).collect()
    assert len(out) == 91 and all(r.predicted == (r.doc_id % 3 == 0) for r in out if r.doc_id != 500)
    none = docs(spark, [(1, "x")]).filter("false")
    assert toxicity.classify(none, labels).count() == 0
    assert lines.line_digests(none).count() == 0 and substrings.repeat_digests(none).count() == 0 and fingerprint.simhash_components(none).count() == 0
    assert packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
