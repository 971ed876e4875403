"""Byte-level BPE by a shuffle of distinct words: every distinct pre-token of the corpus is encoded once.

1. One pass cuts the texts into pre-tokens and explodes them by block (some megabytes of documents): a block's distinct words
   get places by falling frequency and are dealt into buckets by hash, and each document becomes the sequence of its words'
   places. Rows are sorted by their content's hash first, so a task that is run again makes the same blocks and places from the
   same rows, in whatever order they come.
2. One shuffle takes words to their buckets and sequences to their blocks. All blocks' words of one bucket meet in one task,
   which encodes each distinct word once. Rows are packed (words, or their ids, compressed), so a common word costs one entry a
   block, never one a document. There are as many buckets as the shuffle has partitions, twice.
3. A second shuffle joins the ids back to their blocks, where the sequences put them together by position; that every bucket has
   come with as many words as the block dealt to it is checked. Decoding joins the table of token bytes on the id; the table has
   the vocabulary's size, so each task holds it sorted by id. `decode` is the same join for ids that come from elsewhere.

Null and empty texts have no tokens and decode to nothing. Repeated rows are encoded alike. Order within a text is by position;
ties don't occur. Very long texts make a block of their own. An empty table gives no rows. Other columns of the input are not
read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, keyed_texts, map_arrow

#: Words or ids of a block's bucket (bucket from 0 on), the buckets of its places (BUCKETS), or some documents' places (PLACES).
ROWS = pa.schema([("deal", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), ("docs", pa.list_(pa.int64())), ("n", pa.int32()), ("data", pa.binary())])
BUCKETS, PLACES = -1, -2
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

#: Characters with the property White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@dataclass(frozen=True)
class ByteBPE:
    """The ranks' file and the pattern of pre-tokens; block_bytes of text share one table of words. Buckets: twice as many as the
    shuffle's partitions unless given."""

    path: str
    pattern: str
    block_bytes: int = 24_000_000
    buckets: int | None = None


class Splitter:
    """Pre-tokens of texts. No match of the pattern crosses from other characters into white space, so texts are first cut
    there, and the pattern is only run on pieces not met before."""

    def __init__(self, pattern: str):
        import re

        import regex

        own = pattern.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")
        self.cut = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.find = regex.compile(own).findall

    def __call__(self, text: str) -> list[str]:
        return [w for piece in self.cut(text) for w in self.find(piece)]


class _Places(dict):
    """Piece -> places of its words, as bytes; words get places as they come."""

    def __init__(self, find, places: dict[str, int]):
        self.find, self.places = find, places

    def __missing__(self, piece: str) -> bytes:
        places, out = self.places, []
        for w in self.find(piece):
            p = places.get(w)
            if p is None:
                p = places[w] = len(places)
            out.append(p)
        self[piece] = found = np.array(out, "<u4").tobytes() if len(out) > 1 else out[0].to_bytes(4, "little")
        return found


def _blocks(how: ByteBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes], dict[str, int], np.ndarray]]:
    """(block, doc_ids, sequences, places as words came)."""
    part, number = TaskContext.get().partitionId(), 0
    split = Splitter(how.pattern)

    def fresh():
        places: dict[str, int] = {}
        return places, _Places(split.find, places), [], []

    places, pieces, ids, seqs = fresh()
    size = 0
    for batch, texts in by_chunks(batches):
        for doc, t in zip(batch.column(0).to_pylist(), texts, strict=True):
            if size and size + len(t) > how.block_bytes:
                yield (part << 32) + number, ids, seqs, places
                number += 1
                places, pieces, ids, seqs = fresh()
                size = 0
            ids.append(doc)
            seqs.append(b"".join(map(pieces.__getitem__, split.cut(t.decode("utf-8", "replace")))))
            size += len(t)
    if ids:
        yield (part << 32) + number, ids, seqs, places


def _lengths(a: list[int] | np.ndarray) -> bytes:
    return np.asarray(a, "<u4").tobytes()


def _planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all 32-bit numbers, then the second ones...: they compress far better than mixed."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes, offset: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8, offset=offset).reshape(4, -1).T).view("<u4").ravel()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _split_rows(how: ByteBPE, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for block, ids, seqs, places in _blocks(how, batches):
        words = [w.encode("utf-8", "surrogatepass") for w in places]
        came = [np.frombuffer(s, "<u4") for s in seqs]
        often = np.zeros(len(words), np.int64)
        for c in came:
            np.add.at(often, c, 1) if len(c) < 64 else np.add(often, np.bincount(c, minlength=len(words)), out=often)
        often = often.tolist()
        order = sorted(range(len(words)), key=lambda i: (-often[i], words[i]))
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        words = [words[i] for i in order]
        bucket = [zlib.crc32(w) % buckets for w in words]
        dealt: dict[int, list[bytes]] = {}
        for b, w in zip(bucket, words, strict=True):
            dealt.setdefault(b, []).append(w)
        rows = [(b, block, b, None, len(w), press(_lengths([len(x) for x in w]) + b"".join(w))) for b, w in dealt.items()]
        deal = buckets + block
        rows.append((deal, block, BUCKETS, None, len(bucket), press(_planes(np.array(bucket, "<u4")))))
        yield _batch(rows, ROWS)
        # documents are compressed together, as each one alone would bring tables of its own
        for at in range(0, len(ids), 64):
            own, some = ids[at : at + 64], came[at : at + 64]
            data = _lengths([len(c) for c in some]) + _planes(place[np.concatenate(some)])
            yield _batch([(deal, block, PLACES, own, len(own), press(data))], ROWS)


_kernels: dict[str, object] = {}


def kernel(path: str):
    """(encode, ranks) of a ranks' file; kept by the worker."""
    if path not in _kernels:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _kernels[path] = (tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, ranks)
    return _kernels[path]


def _encode(how: ByteBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed words to packed ids; a word is encoded at its first appearance in the task. Other rows pass."""
    import zstandard

    press, expand = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
    encode, known = kernel(how.path)[0], {}
    for batch in batches:
        of_words = pc.greater_equal(batch.column(2), 0)
        yield batch.filter(pc.invert(of_words))
        rows = []
        for deal, block, bucket, _, n, data in zip(*(c.to_pylist() for c in batch.filter(of_words).columns), strict=True):
            raw = expand(data)
            ends = np.cumsum(np.frombuffer(raw, "<u4", n)).tolist()
            raw, start, lens, out = raw[4 * n :], 0, [], []
            if len(known) > 1_000_000:
                known.clear()
            for end in ends:
                w = raw[start:end]
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(encode(w), "<u4").tobytes()
                lens.append(len(ids) // 4)
                out.append(ids)
                start = end
            rows.append((deal, block, bucket, None, n, press(_lengths(lens) + _planes(np.frombuffer(b"".join(out), "<u4")))))
        yield _batch(rows, ROWS)


def _gather(start: np.ndarray, length: np.ndarray, flat: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The slices flat[start[p] : start[p] + length[p]] for p in pick, one after another."""
    n = length[pick]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    shift = np.repeat(start[pick] - (ends - n), n)
    return flat[np.arange(ends[-1]) + shift]


def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of token bytes by id: start, length, all bytes; kept by the worker."""
    if ("table", path) not in _kernels:
        by_id = {i: b for b, i in kernel(path)[1].items()}
        table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        length = np.array([len(b) for b in table], np.int64)
        _kernels["table", path] = (np.cumsum(length) - length, length, np.frombuffer(b"".join(table), np.uint8))
    return _kernels["table", path]


def _assemble(how: ByteBPE, digests: bool, block: pa.Table) -> pa.Table:
    """A block's documents from its words' ids."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    kind = block.column("bucket").combine_chunks()
    words, seqs = block.filter(pc.greater_equal(kind, 0)), block.filter(pc.equal(kind, PLACES))
    bucket_of = _numbers(expand(block.filter(pc.equal(kind, BUCKETS)).column("data")[0].as_py()))
    # a bucket's words are in the order of their places
    mine, where = np.argsort(bucket_of, kind="stable"), np.bincount(bucket_of, minlength=1)
    lens, flats, came = [], [], np.zeros(len(where), np.int64)
    for b, n, data in sorted(zip(words.column("bucket").to_pylist(), words.column("n").to_pylist(), words.column("data").to_pylist(), strict=True)):
        raw = expand(data)
        came[b] += n
        lens.append(np.frombuffer(raw, "<u4", n).astype(np.int64))
        flats.append(_numbers(raw, 4 * n))
    if not np.array_equal(came, where):
        raise ValueError("a block's words and sequences don't belong together")
    length, flat = np.concatenate([np.zeros(0, np.int64), *lens]), np.concatenate([np.zeros(0, "<u4"), *flats])
    start = np.cumsum(length) - length
    by_place = np.empty((2, len(mine)), np.int64)
    by_place[0, mine], by_place[1, mine] = start, length
    start, length = by_place
    table = _token_bytes(how.path)
    rows = []
    for own, n, data in zip(seqs.column("docs").to_pylist(), seqs.column("n").to_pylist(), seqs.column("data").to_pylist(), strict=True):
        raw = expand(data)
        places = np.split(_numbers(raw, 4 * n), np.cumsum(np.frombuffer(raw, "<u4", n))[:-1].astype(np.int64))
        for doc, own_places in zip(own, places, strict=True):
            ids = _gather(start, length, flat, own_places)
            raw, text = ids.astype("<u4").tobytes(), _gather(*table, ids).tobytes()
            rows.append((doc, len(ids), sha256(raw).hexdigest(), sha256(text).hexdigest()) if digests else (doc, len(ids), raw, text))
    return pa.Table.from_batches([_batch(rows, DIGESTS if digests else OUT)])


def encode_decode(docs: DataFrame, how: ByteBPE, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per document, ids as little-endian unsigned 32-bit numbers; or their SHA-256."""
    from pyspark.sql.pandas.types import from_arrow_schema

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = how.buckets or 2 * parts
    texts = keyed_texts(docs).select("doc_id", "text", "row_key").sortWithinPartitions("row_key", "doc_id").select("doc_id", "text")
    rows = map_arrow(texts, lambda batches: _split_rows(how, buckets, batches), ROWS).repartition(parts, "deal")
    rows = map_arrow(rows, lambda batches: _encode(how, batches), ROWS)
    return rows.groupBy("block").applyInArrow(lambda block: _assemble(how, digests, block), from_arrow_schema(DIGESTS if digests else OUT))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, token): the bytes of each id of a ranks' file."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in kernel(path)[1].items()], "id long, token binary")


def decode(rows: DataFrame, tokens: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the bytes of an array of ids per row, by a join on the id. Null or empty arrays give no bytes, an id that
    the table lacks gives none; keys that repeat, nulls included, give a row each."""
    own = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    each = own.select("row", "key", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(tokens.select("id", F.hex("token").alias("hex"))), "id", "left")
    joined = each.groupBy("row").agg(F.first("key").alias(key), F.sort_array(F.collect_list(F.struct("at", "hex"))).alias("own"))
    return joined.select(key, F.unhex(F.array_join(F.transform("own", lambda x: x["hex"]), "")).alias("decoded"))
