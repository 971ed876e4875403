"""Line deduplication by range-partitioned hashes; text stays where it is, bitmaps say what remains.

Each line's key (ASCII white space stripped, A-Z lower-cased) becomes a 128-bit hash. Rows (hash, document, position) are
range-partitioned and sorted, so that occurrences of one key stream past in order of document and position, first one first.
A very common key spreads over several partitions: the ranges cut within a key, and each partition reports the counts of
its first and last key (two rows each), from which the driver adds up the keys that cross a border. The result is a
compressed bitmap of kept lines for each document that loses some; texts are only joined to it to apply it.

A null or empty text is one empty line. Keys with fewer than `min_chars` code points are never dropped. Documents are told
apart by doc_id, rows without one by their text; repeated rows of one doc_id count as one document and are treated alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, keyed_texts, map_arrow

WHITE = b" \t\n\x0b\x0c\r"

ROWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("uid", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
EDGES = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("first_uid", pa.int64()), ("last_uid", pa.int64())])
DROPS = pa.schema([("uid", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
BITMAPS = pa.schema([("uid", pa.int64()), ("row_key", pa.int64()), ("n_dropped", pa.int64()), ("keep_bitmap", pa.binary())])


@dataclass(frozen=True)
class LineRule:
    """keep_first: the first occurrence of a common key stays; else all its lines go."""

    min_docs: int = 10
    min_chars: int = 1
    keep_first: bool = False


def _uid():
    return F.coalesce("doc_id", "row_key")


def _hashes(rule: LineRule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch, texts in by_chunks(batches):
        pos, counts, raw = [], [], []
        for t in texts:
            lines = [x.strip(WHITE).lower() for x in t.split(b"\n")]
            own = [i for i, x in enumerate(lines) if x and (rule.min_chars <= 1 or len(x.decode("utf-8", "replace")) >= rule.min_chars)]
            pos += own
            counts.append((len(own), len(lines)))
            raw += [digest(lines[i]) for i in own]
        h = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        n = np.array([c for c, _ in counts], np.int64)
        spread = lambda a: np.repeat(np.asarray(a), n)
        columns = [h[:, 0], h[:, 1], spread(batch.column(0).to_numpy(zero_copy_only=False)), spread(batch.column(1).to_numpy(zero_copy_only=False)), pos, spread([c for _, c in counts])]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)


class _Runs:
    """Splits sorted batches into runs of one key; a run may come in several parts."""

    @staticmethod
    def of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], slice, np.ndarray]]:
        h1, h2, uid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        bounds = [0, *cut.tolist(), len(h1)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield (int(h1[a]), int(h2[a])), slice(a, b), uid


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The document counts of a partition's first and last key."""
    part, done, now = TaskContext.get().partitionId(), [], None
    for batch in batches:
        for key, where, uid in _Runs.of(batch):
            u = uid[where]
            docs = 1 + int((u[1:] != u[:-1]).sum())
            if now and now[0] == key:
                now[1] += docs - (now[3] == int(u[0]))
                now[3] = int(u[-1])
            else:
                if now and not done:
                    done.append(now)
                now = [key, docs, int(u[0]), int(u[-1])]
    done += [now] if now else []
    rows = [(part, i, k[0], k[1], n, a, b) for i, (k, n, a, b) in enumerate(done)]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, schema=EDGES)


def _crossing(rows: list) -> dict[tuple[int, int], int]:
    """Document counts of the keys that reach over a border: two rows a partition at most come in."""
    total: dict[tuple[int, int], list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.part, r.seq)):
        key = (r.h1, r.h2)
        if key in total:
            t = total[key]
            t[0] += r.docs - (t[1] == r.first_uid)
            t[1], t[2] = r.last_uid, t[2] + 1
        else:
            total[key] = [r.docs, r.last_uid, 1]
    return {k: t[0] for k, t in total.items() if t[2] > 1}


def _drops(rule: LineRule, crossing, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lines to drop. Of a key that isn't yet known to be common only min_docs documents' rows wait."""
    known = crossing.value
    starts = TaskContext.get().partitionId()
    key, waiting, docs, last, common, seen, first = None, [], 0, None, False, False, None
    for batch in batches:
        out = []
        rest = batch.select(["uid", "row_key", "pos", "n_lines"])
        for k, where, uid in _Runs.of(batch):
            if k != key:
                key, waiting, docs, last = k, [], 0, None
                common = known[k][0] >= rule.min_docs if k in known else False
                seen = k in known and known[k][1] < starts
                first = None
            u = uid[where]
            docs += 1 + int((u[1:] != u[:-1]).sum()) - (last == int(u[0]))
            last = int(u[-1])
            piece = rest.slice(where.start, where.stop - where.start)
            if rule.keep_first and not seen:
                first, seen = [piece.column(c)[0].as_py() for c in range(3)], True
            if first:
                # a repeated row has the same first line at the same place; its bitmap serves both
                again = 0
                while again < len(piece) and [piece.column(c)[again].as_py() for c in range(3)] == first:
                    again += 1
                first = first if again == len(piece) else None
                piece = piece.slice(again)
            waiting.append(piece)
            if common or docs >= rule.min_docs and k not in known:
                common = True
                out += waiting
                waiting = []
            elif k in known:
                waiting = []
        if out:
            yield from pa.Table.from_batches(out, schema=DROPS).combine_chunks().to_batches()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, maps = [], []
        for pos, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[pos] = False
            dropped.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], schema=BITMAPS)


def keep_bitmaps(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """(uid, row_key, n_dropped, keep_bitmap) of the documents that lose lines; bit i of the bitmap is line i."""
    spark = docs.sparkSession
    texts = keyed_texts(docs).select(_uid().alias("uid"), "row_key", "text")
    rows = map_arrow(texts, lambda batches: _hashes(rule, batches), ROWS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "uid", "row_key", "pos"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()
    edges = map_arrow(rows, _borders, EDGES).collect()  # two rows a partition
    first_part: dict[tuple[int, int], int] = {}
    for r in sorted(edges, key=lambda r: r.part):
        first_part.setdefault((r.h1, r.h2), r.part)
    crossing = spark.sparkContext.broadcast({k: (n, first_part[k]) for k, n in _crossing(edges).items()})
    drops = map_arrow(rows, lambda batches: _drops(rule, crossing, batches), DROPS)
    grouped = drops.groupBy("uid", "row_key").agg(F.collect_set("pos").alias("pos"), F.max("n_lines").alias("n_lines"))
    return map_arrow(grouped, _bitmaps, BITMAPS)


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[bytes, int]:
    """The text of the lines that stay, and how many lines there were."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little").tolist()
    return b"\n".join([x for x, k in zip(lines, keep, strict=True) if k]), len(lines)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, row_key, text, n_dropped, keep_bitmap): every document, with nulls where nothing is dropped."""
    d = keyed_texts(docs).withColumn("uid", _uid())
    return d.join(bitmaps, ["uid", "row_key"], "left").select("doc_id", "row_key", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep_bitmap")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
TEXT = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("text", pa.string()), ("n_dropped", pa.int64())])


def line_digests(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per document."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches):
            kept = [kept_lines(t, m) for t, m in zip(texts, batch.column(4).to_pylist(), strict=True)]
            columns = [batch.column(0), pa.array([n for _, n in kept], pa.int64()), batch.column(3), pa.array([sha256(t).hexdigest() for t, _ in kept])]
            yield pa.RecordBatch.from_arrays(columns, schema=DIGEST)

    return map_arrow(with_bitmaps(docs, keep_bitmaps(docs, rule)), run, DIGEST)


def drop_lines(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """(doc_id, row_key, text, n_dropped): documents with their kept lines as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches):
            kept = [kept_lines(t, m)[0].decode("utf-8", "replace") for t, m in zip(texts, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept), batch.column(3)], schema=TEXT)

    return map_arrow(with_bitmaps(docs, keep_bitmaps(docs, rule)), run, TEXT)


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.k = c.k
GROUP BY doc_id
"""
