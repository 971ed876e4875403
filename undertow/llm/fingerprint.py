"""SimHash fingerprints over word shingles, and groups of documents whose fingerprints differ in few bits.

Words are runs outside ASCII white space, A-Z lower-cased. A shingle is `width` words joined by blanks; its hash is XXH64 of
its UTF-8 with a fixed seed. A bit of the fingerprint is set if it is set in over half of the hashes, repeats included.

Pairs are sought among distinct fingerprints only, so copies cost nothing. Fingerprints at most `max_bits` apart agree in at
least two of six blocks of bits; each of the 15 pairs of blocks is a table, whose key is these two blocks. Within a key the
pivot distance table decides: Hamming distances to fixed reference fingerprints are computed once for each row, rows are
sorted by the first of them, and a pair whose distances differ by more than `max_bits` in any coordinate is discarded; what
survives is verified. A key with more than `tile` rows is dealt over pairs of tiles. What leaves a task is a spanning forest
of the links it found, never all pairs of a group.

Nulls and empty texts have no words: fingerprint zero, linked like any other. Fewer than `width` words: one shingle of all
of them. Repeated rows have equal fingerprints and one row of the result each. A null doc_id names no component. Ties don't
occur: every link within the limit counts. Very long texts are hashed whole. An empty table gives no rows. Columns other than
doc_id and text are not read.

Pivots alone can't be the index: a coordinate is a distance around 32 with a deviation of 4, so a difference of 4 or fewer keeps
57 % of random pairs, and 12 coordinates about 0.1 %: too many of all pairs of a large corpus, and none of them could be left
unread without a key. So keys of blocks say which rows meet, and the table discards within a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, keyed_texts, map_arrow, with_columns
from undertow.llm.graph import component_roots

FP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("fp", pa.int64())])
LINK_SCHEMA = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

#: Widths of the six blocks; together 64 bits.
BLOCKS = (11, 11, 11, 11, 10, 10)


@dataclass(frozen=True)
class SimHash:
    width: int = 4
    seed: int = 42
    max_bits: int = 4
    pivots: int = 12
    tile: int = 4096


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(joined, seed)
    else:
        hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """(doc_id, row_key, fp): one row per document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches):
            yield with_columns(batch, ["doc_id", "row_key"], FP_SCHEMA, fp=[signed(fingerprint(t, how.width, how.seed)) for t in texts])

    return map_arrow(keyed_texts(docs), run, FP_SCHEMA)


def pivot_points(n: int) -> np.ndarray:
    """Fixed reference fingerprints: the first n numbers of the splitmix64 sequence from 1."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def linked_forest(key: np.ndarray, fp: np.ndarray, max_bits: int, pivots: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Rows i, j of a spanning forest of the links within equal keys, as an array of shape (2, n).

    side: where given, only pairs of different sides count (tiles of one key)."""
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.lexsort([table[:, 0], key])
    key, fp, table = key[order], fp[order], table[order]
    parent = np.arange(len(fp))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    i, lag = np.arange(len(fp) - 1), 1
    while len(i):
        j = i + lag
        near = (key[i] == key[j]) & (table[j, 0] - table[i, 0] <= max_bits)
        i = i[near]
        j = i + lag
        close = (np.abs(table[i, 1:] - table[j, 1:]) <= max_bits).all(axis=1)
        a, b = i[close], j[close]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        for first, second in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            x, y = find(first), find(second)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((first, second))  # not the roots, which would make hubs
        lag += 1
        i = i[i + lag < len(fp)]
    return order[np.array(out, np.int64).reshape(-1, 2).T]


def _links(how: SimHash, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, links within keys; a key's rows are held together, and they are at most two tiles."""
    pivots = pivot_points(how.pivots)

    def emit(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = linked_forest(key, fp, how.max_bits, pivots)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], schema=LINK_SCHEMA)

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
        if len(keys) < 60_000:
            continue
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole:
            yield emit(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield emit(keys, fps)


def fingerprint_links(nodes: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """(src, dst): links that connect all distinct fingerprints (column fp) within `max_bits`, directly or by others.

    Blocks agree in at least 6 - max_bits, so the tables are complete for max_bits of 4 or fewer."""
    if how.max_bits > 4:
        raise ValueError("six blocks, two of them equal, hold for 4 bits or fewer")
    shifts = [sum(BLOCKS[:i]) for i in range(6)]
    part = [F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1) for s, w in zip(shifts, BLOCKS, strict=True)]
    keys = [
        F.lit(t << 32).bitwiseOR(F.shiftleft(part[a], 11)).bitwiseOR(part[b]) for t, (a, b) in enumerate(combinations(range(6), 2))
    ]
    rows = nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")
    sizes = rows.groupBy("key").count().filter("count > 1")
    rows = rows.join(sizes, "key")
    # a key with more rows than a tile: each row goes to the pairs of tiles that its own tile is in
    tiles = F.ceil(F.col("count") / how.tile)
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    rows = (
        rows.withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("pair", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.least(t, F.col("own")) * F.col("tiles") + F.greatest(t, F.col("own"))))))
        .select(F.when(F.col("tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"), "fp")
    )
    rows = rows.repartition("key").sortWithinPartitions("key")
    return map_arrow(rows, lambda batches: _links(how, batches), LINK_SCHEMA)


def _classes(prints: DataFrame, how: SimHash) -> DataFrame:
    """(fp, component_id): for each distinct fingerprint, the smallest doc_id that has one linked to it."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = component_roots(fingerprint_links(nodes, how))
    # both written out, so that the join on the root is one that Spark can split by a hot component's rows
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id")).checkpoint()
    return named.join(smallest, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """(doc_id, row_key, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    prints = fingerprints(docs, how).checkpoint()
    return prints.join(_classes(prints, how), "fp").select("doc_id", "row_key", "fp", "component_id")


def representatives(docs: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """(doc_id, row_key): one document of each component, the one with the smallest doc_id (nulls last)."""
    prints = fingerprints(docs, how).checkpoint()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_key")).alias("r")
    return prints.join(_classes(prints, how), "fp").groupBy("root").agg(first).select("r.doc_id", "r.row_key")


def hex_digits(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
