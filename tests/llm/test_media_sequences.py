"""Pages with several media: order, captions and payloads stay aligned; every column of the query against plain values."""

import hashlib
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from undertow.llm import media  # noqa: E402


def png(text):
    return media.to_png(media.padded(text.encode()))


def digest(text):
    return hashlib.sha256(media.padded(text.encode())).hexdigest()


def test_sequences_keep_order_and_captions(spark):
    img = lambda t, extra="": f'<img src="sha256:{digest(t)}"{extra}>'
    one = f"<p>First &amp;\n one</p><figure>{img('A')}{img('B')}<figcaption>Two <b>media</b></figcaption></figure><p>mid</p>{img('A', ' alt=again')}tail"
    two = f'<p>x</p><img src="sha256:{"0" * 64}"><img src="http://elsewhere/a.png"><p>y</p>'
    pages = [(1, one), (2, two), (2, two), (2, "<p>other page</p>"), (3, None), (4, ""), (None, img("C")), (5, "<p>" + "long " * 40_000 + "</p>" + img("B"))]
    d = spark.createDataFrame([(i, h, "z", 0) for i, h in pages], "page_id long, html string, digest string, position int")
    store = spark.createDataFrame([(digest(t), bytearray(png(t)), 1) for t in "ABC"], "digest string, media binary, kind int")
    rows = media.interleaved(media.items(d), store, "media").collect()
    got = sorted(((str(r.page_id), [(x.position, x.kind, x.text, x.caption, x.media and bytes(x.media)) for x in r["items"]]) for r in rows), key=str)
    a, b, c = (png(t) for t in "ABC")
    missing = [(0, "text", "x", None, None), (1, "media", None, None, None), (2, "text", "y", None, None)]
    want = [
        ("1", [(0, "text", "First & one", None, None), (1, "media", None, "Two media", a), (2, "media", None, "Two media", b), (3, "text", "mid", None, None), (4, "media", None, "again", a), (5, "text", "tail", None, None)]),
        ("2", missing), ("2", missing), ("2", [(0, "text", "other page", None, None)]),
        ("5", [(0, "text", ("long " * 40_000).strip(), None, None), (1, "media", None, None, b)]),
        ("None", [(0, "media", None, None, c)]),
    ]
    assert got == sorted(want, key=str)
    assert media.interleaved(media.items(d.filter("false")), store, "media").count() == 0


def test_every_column_of_the_query(spark):
    texts = [(0, "one"), (1, "x" * 576), (2, "é" * 500), (3, None), (4, ""), (5, "one"), (5, "one"), (5, "two"), (None, "no id"), (6, "long " * 60_000)]
    d = spark.createDataFrame([(i, t, "p", b"m") for i, t in texts], "doc_id long, text string, payload_sha256 string, media binary")
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = media.to_png(whole)
        assert media.from_png(stored) == whole
        want.append((str(i), len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(whole), 1, f"{len(raw)} bytes & padding", 3))
    got = [(str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.position, r.caption, r.n_items) for r in media.document_media(d).collect()]
    assert sorted(got) == sorted(want)
    assert media.document_media(d.filter("false")).count() == 0
