"""Groups of near copies: documents linked where the Jaccard similarity of their sets of word shingles reaches a bound.

Words are those of fingerprint.py; a shingle is `width` words, and a text of fewer words is one shingle. Shingles stand for
themselves as 64-bit hashes. Documents with equal sets are one node, so exact copies cost nothing; texts without words are one.

SimHash gives the first pairs: fingerprints over the same shingles, whose pivot distance tables find those that differ in few
bits; each pair is verified on the whole sets. A limit on bits can't promise a similarity (at 0.8, ten bits of 64 differ on
average), so exact rounds go with it that leave no pair to chance. In any one order of all shingles, two sets of similarity t share a shingle
among the first n - ceil(t n) + 1 of either (n its size), so only these prefixes are shuffled. The order is by hash, with
shingles that a sample shows to be common last: the sample decides how much work there is, never the result. Round one compares
neighbours in size under each shared shingle and joins what is similar; round two compares all pairs whose groups still differ.
Pairs of round two are first held to a sketch (the parity of a set's shingles by bucket of hashes), then all pairs to the counts
by bucket; both bound what two sets can share, and neither loses a similar pair. What is left is verified on the whole sets.

Nulls and empty texts have no words and are copies of each other. Repeated rows are copies, each a row of the result. Very long
texts are one set each. Ties among doc_ids that stay are settled by the text's hash, null ids come last. An empty table gives no
rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, keyed_texts, map_arrow
from undertow.llm.fingerprint import SimHash, fingerprint, fingerprint_links, signed
from undertow.llm.graph import component_roots

#: Buckets of hashes whose counts are compared first.
BUCKETS = 256

ROWS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("node", pa.int64()), ("counts", pa.binary()), ("sketch", pa.binary()), ("fp", pa.int64())])
TOKENS = pa.schema([("token", pa.int64())])
PREFIXES = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@dataclass(frozen=True)
class Near:
    """Similar: a Jaccard similarity of at least part / whole. One document of `sample` is looked at for common shingles. Up to
    `max_keys` keys of texts to verify are broadcast (8 bytes each); beyond that the texts are joined instead."""

    width: int = 5
    part: int = 4
    whole: int = 5
    sample: int = 16
    max_common: int = 100_000
    max_keys: int = 1_000_000
    simhash: SimHash = SimHash(width=5)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """By text, the sorted distinct hashes of its shingles; none for a text without words."""
    known: dict[bytes, int] = {}
    out = []
    for t in texts:
        words = t.lower().split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 42)
        h = np.array([known[w] for w in words], np.uint64)
        n = min(width, len(h))
        total = np.zeros(max(len(h) - n + 1, 0) if n else 0, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
        out.append(np.unique(total).view(np.int64))
    return out


def _node(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(s.tobytes(), 7), "big", signed=True)


def _counts(s: np.ndarray) -> bytes:
    """How many shingles are in each bucket, a byte each; empty where a byte can't say it."""
    n = np.bincount(s & (BUCKETS - 1), minlength=BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def _sketch(s: np.ndarray) -> bytes:
    """By bucket, whether the number of shingles is odd: a shingle that only one of two sets has changes one bit, so two sets
    differ in at least as many shingles as their sketches do in bits."""
    return np.packbits(np.bincount(s & (BUCKETS - 1), minlength=BUCKETS) & 1).tobytes()


def _possible(how: Near, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (columns a, b, x, y; x and y are their counts) that can share enough shingles; what has no counts can."""
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        known = np.array([bool(p and q) for p, q in zip(x, y, strict=True)], bool)
        x, y = (np.frombuffer(b"".join(v for v, k in zip(c, known, strict=True) if k), np.uint8).reshape(-1, BUCKETS) for c in (x, y))
        shared = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        total = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
        stays = ~known
        stays[known] = shared * (how.part + how.whole) >= how.part * total
        yield batch.select(["a", "b"]).filter(pa.array(stays))


def _prefix(s: np.ndarray, common: np.ndarray, how: Near) -> np.ndarray:
    """The first of a set's shingles in the order of all: common ones last, else by hash."""
    n = len(s) - -(-how.part * len(s) // how.whole) + 1
    if len(common):
        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:n]


def _groups(batches: Iterator[pa.RecordBatch], columns: int, sketches: bool = False) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one; its equal values are never torn apart. The last may be sketches, as four numbers."""
    held = [np.zeros(0, np.int64)] * columns + [np.zeros((0, BUCKETS // 64), np.uint64)] * sketches
    for batch in batches:
        own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if sketches:
            own.append(np.frombuffer(b"".join(batch.column(columns).to_pylist()), np.uint64).reshape(-1, BUCKETS // 64))
        held = [np.concatenate([x, y]) for x, y in zip(held, own, strict=True)]
        if len(held[0]) >= 60_000 and (whole := int(np.searchsorted(held[0], held[0][-1]))):
            yield [x[:whole] for x in held]
            held = [x[whole:] for x in held]
    if len(held[0]):
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token, size and node: those of tokens with more than one node, each once."""
    for token, size, node in _groups(batches, 3):
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, size, node = token[fresh], size[fresh], node[fresh]
        same = token[1:] == token[:-1]
        many = np.zeros(len(token), bool)
        many[1:] |= same
        many[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (token, node, size)], schema=PREFIXES)


def _pairs(how: Near, batches: Iterator[pa.RecordBatch], neighbours: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of one token (columns token, size, node, root, and sketch but for neighbours) of different roots whose sizes and
    sketches allow the similarity."""
    for token, size, node, root, *rest in _groups(batches, 4, not neighbours):
        i, lag = np.arange(len(token) - 1), 1
        while len(i):
            j = i + lag
            i = i[(token[i] == token[j]) & (how.whole * size[i] >= how.part * size[j])]
            j = i + lag
            differ = root[i] != root[j]
            for sketch in rest:
                # similar sets differ in (whole - part) / (whole + part) of both sizes at most
                bits = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
                differ &= bits * (how.whole + how.part) <= (how.whole - how.part) * (size[i] + size[j])
            if differ.any():
                ends = np.stack([node[i[differ]], node[j[differ]]])
                ends = np.unique(np.sort(ends, axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], schema=PAIRS)
            lag += 1
            i = i[:0] if neighbours else i[i + lag < len(token)]


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, how: Near) -> DataFrame:
    """(src, dst): the pairs that are similar. Only the texts of their ends are cut into shingles again."""
    x, y = (nodes.select(F.col("node").alias(end), F.col("counts").alias(c)) for end, c in (("a", "x"), ("b", "y")))
    pairs = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y")
    pairs = map_arrow(pairs, lambda batches: _possible(how, batches), PAIRS).checkpoint()
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("row_key").checkpoint()
    texts = keyed_texts(docs)
    few = ends.count() <= how.max_keys
    wanted = None
    if few:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(ends.toArrow().column("row_key").to_numpy()))
    else:
        texts = texts.join(ends, "row_key", "left_semi").select("doc_id", "row_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(np.isin(batch.column(1).to_numpy(zero_copy_only=False), wanted.value)))
            for _, texts in by_chunks(iter([batch])):
                sets = {n: s for s in shingle_sets(texts, how.width) if (n := _node(s)) not in done}
                done.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.list_(pa.int64()))], schema=SETS)

    sets = map_arrow(texts, run, SETS).groupBy("node").agg(F.first("shingles").alias("shingles")).checkpoint()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    similar = shared * (how.part + how.whole) >= how.part * (F.size("x") + F.size("y"))
    return both.filter(similar).select(F.col("a").alias("src"), F.col("b").alias("dst")).checkpoint()


def _fingerprint_pairs(nodes: DataFrame, how: Near) -> DataFrame:
    """(a, b): pairs that connect nodes whose fingerprints are equal or differ in few bits."""
    own = nodes.select("node", "fp")
    lead = own.groupBy("fp").agg(F.min("node").alias("lead")).checkpoint()
    same = own.join(lead, "fp").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(lead.select("fp"), how.simhash)
    links = links.join(lead.select(F.col("fp").alias("src"), F.col("lead").alias("x")), "src").join(lead.select(F.col("fp").alias("dst"), F.col("lead").alias("y")), "dst")
    return same.unionByName(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_copies(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, row_key, root): rows whose root is equal are linked by similar pairs, directly or by others."""
    spark = docs.sparkSession
    texts = keyed_texts(docs)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in by_chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(own, how.width)))], schema=TOKENS)

    often = map_arrow(texts.filter(F.pmod("row_key", F.lit(how.sample)) == 0), tokens, TOKENS).groupBy("token").count().filter("count > 2")
    common = spark.sparkContext.broadcast(np.sort(np.array([r.token for r in often.orderBy(F.desc("count"), "token").limit(how.max_common).collect()], np.int64)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in by_chunks(batches):
            sets = shingle_sets(own, how.width)
            prints = [signed(fingerprint(t, how.simhash.width, how.simhash.seed)) for t in own]
            columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([_counts(s) for s in sets], pa.binary()), pa.array([_sketch(s) for s in sets], pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=ROWS)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, own in by_chunks(batches):
            sets = {n: s for s in shingle_sets(own, how.width) if len(s) and (n := _node(s)) not in done}
            done.update(sets)
            parts = [_prefix(s, common.value, how) for s in sets.values()]
            if parts:
                counts = [len(p) for p in parts]
                columns = [np.concatenate(parts), np.repeat(np.array(list(sets), np.int64), counts), np.repeat(np.array([len(s) for s in sets.values()], np.int64), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=PREFIXES)

    rows = map_arrow(texts, named, ROWS).checkpoint()
    nodes = rows.groupBy("node").agg(F.min(F.struct("row_key", "counts", "sketch", "fp")).alias("r")).select("node", "r.row_key", "r.counts", "r.sketch", "r.fp").checkpoint()
    order = ["token", "size", "node"]
    dealt = map_arrow(texts, prefixes, PREFIXES).repartition("token").sortWithinPartitions(*order)
    groups = map_arrow(dealt.select(*order), _shared, PREFIXES).checkpoint()
    near = map_arrow(groups.select(*order, F.col("node").alias("root")), lambda b: _pairs(how, b, True), PAIRS)
    links = _verified(docs, nodes, near.unionByName(_fingerprint_pairs(nodes, how)), how)
    rooted = groups.join(component_roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(nodes.select("node", "sketch"), "node").repartition("token").sortWithinPartitions(*order).select(*order, "root", "sketch")
    links = links.union(_verified(docs, nodes, map_arrow(rooted, lambda b: _pairs(how, b, False), PAIRS), how))
    roots = component_roots(links)
    return rows.join(roots, "node", "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, row_key): one document of each group, the one with the smallest doc_id (nulls last)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key")).alias("r")
    return near_copies(docs, how).groupBy("root").agg(first).select("r.doc_id", "r.row_key")
