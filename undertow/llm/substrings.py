"""Removal of substrings that occur elsewhere: suffixes compared by prefix hashes, over the whole corpus.

A string of `length` bytes that starts at two places goes at both. Every such window is assigned its anchor: the `gram` bytes in
it with the smallest hash. Equal windows have equal anchors at equal places, so the corpus meets on anchors, about one for 70
bytes, instead of on positions; neighbouring windows with one anchor are one row, and all their bytes are its context.

1. Rows are range-partitioned and sorted by anchor, context hash, document and place, so a common passage spreads over
   partitions and streams past. A row whose context hash occurs again goes on, and so does one row of each hash whose anchor has
   several. Hashes only choose who is compared; nothing is removed on their word.
2. The texts of those rows are looked at again. Contexts that are the same bytes meet within a task, so that each task sends a
   common context once, however many copies it has. What met there is settled; the rest waits for what other tasks have. Contexts
   of a passage overlap, so one is sent whole only if it has to be compared with others or ends a passage; otherwise its own
   bytes are, those before the next context, with a 128-bit hash of the whole.
3. What is sent of one anchor is merge-sorted, two suffixes being compared by binary search for their common extension over
   prefix polynomial hashes; neighbours that compare alike are verified byte by byte. So each byte of a common passage is
   compared once, with the context that it is the own part of; that the overlapping part is alike as well rests on the hash
   and on the next contexts' bytes. Among contexts that differ, the suffixes that may begin a common window are sorted and
   verified likewise, which gives the windows at the borders of common passages.

An anchor with many contexts is dealt over ceil(contexts / per_group) tasks by the hashes of its windows: equal windows meet in
one of them, and a context goes to those that its windows name, at most once a window.

Null and empty texts, and texts shorter than `length`, lose nothing. Repeated rows are copies of each other and lose everything
that is `length` bytes or longer; they share one list of spans. Ties can't occur: every row with a window that is common goes. An
empty table gives no rows. Windows never cross documents. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, keyed_texts, map_arrow

ANCHORS = pa.schema([("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("p", pa.int32())])
FOUND = pa.schema([("a", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.bool_())])
#: A context (its first bytes and the hash of all) or, without bytes, a settled span; `own` contexts wait for a verdict, others
#: were settled where they met.
CONTEXTS = pa.schema(
    [("deal", pa.int64()), ("a", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("own", pa.bool_()),
     ("context", pa.binary()), ("digest", pa.binary())]
)
SPANS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("kept", pa.binary()), ("n_removed", pa.int64())])

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Windows of a very long text are handled in stretches of so many; places in a stretch fit in 20 bits.
STRETCH = 1 << 19


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    gram: int = 64
    per_group: int = 500
    held_bytes: int = 32_000_000


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64; grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_powers = _Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i]: the polynomial hash of the first i bytes."""
    up, _ = _powers.to(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=h[1:])
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def anchors_of(data: bytes, how: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window, and the anchor's place, for runs of windows with one anchor."""
    length, gram = how.length, how.gram
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    if n > STRETCH:
        parts = []
        for o in range(0, n, STRETCH):
            a, lo, hi, p = anchors_of(data[o : min(o + STRETCH, n) + length - 1], how)
            parts.append((a, lo + o, hi + o, p + o))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    width = length - gram + 1
    h = prefix_hashes(np.frombuffer(data, np.uint8))
    grams = len(data) - gram + 1
    _, down = _powers.to(grams)
    x = _mixed((h[gram:] - h[:-gram]) * down[:grams])
    low = np.uint64((1 << 20) - 1)
    key = np.full(-(-grams // width) * width, np.uint64(MASK))
    key[:grams] = (x & ~low) | np.arange(grams, dtype=np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    p = least[first].astype(np.int64)
    return x[p].view(np.int64), first, np.append(first[1:], n) - 1, p


def _anchor_rows(how: Repeats, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, length = xxhash.xxh3_128_digest, how.length
    for batch, texts in by_chunks(batches):
        cols = [[] for _ in range(4)]
        counts, raw = [], []
        for t in texts:
            found = anchors_of(t, how)
            counts.append(len(found[0]))
            for c, v in zip(cols, found, strict=True):
                c.append(v)
            raw += [digest(t[a : b + length], p - a) for a, b, p in zip(found[1].tolist(), found[2].tolist(), found[3].tolist(), strict=True)]
        a, lo, hi, p = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        c = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
        spread = lambda i: np.repeat(np.arange(len(texts)), counts) if i is None else batch.column(i).take(pa.array(np.repeat(np.arange(len(texts)), counts)))
        columns = [a, c[:, 0], c[:, 1], spread(0), spread(1), lo, hi, p]
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v)).cast(f.type) for v, f in zip(columns, ANCHORS, strict=True)], schema=ANCHORS)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted anchors: contexts whose hash occurs again, and one row (first) of each whose anchor has several, or may have
    in a neighbouring partition."""

    def settle(t: pa.Table, open_start: bool, open_end: bool) -> pa.RecordBatch:
        a, c1, c2 = (t.column(i).to_numpy() for i in range(3))
        n = len(a)
        new_a = np.ones(n, bool)
        new_a[1:] = a[1:] != a[:-1]
        new_c = new_a.copy()
        new_c[1:] |= (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        group, run = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        size, kinds = np.bincount(run), np.bincount(group[new_c])
        full = size[run] > 1
        several = kinds[group] > 1
        if open_start:
            several |= group == 0
        if open_end:
            several |= group == group[-1]
        first = several & new_c
        pick = np.flatnonzero(full | first)
        rows = t.select(["a", "doc_id", "row_key", "lo", "hi"]).take(pa.array(pick)).append_column("first", pa.array(first[pick]))
        return pa.RecordBatch.from_arrays([rows.column(f.name).combine_chunks() for f in FOUND], schema=FOUND)

    held: list[pa.RecordBatch] = []
    count, open_start = 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < 100_000:
            continue
        t = pa.Table.from_batches(held)
        a = t.column(0).to_numpy()
        cut = int(np.searchsorted(a, a[-1]))
        if cut:
            yield settle(t.slice(0, cut), open_start, False)
            rest, open_start = t.slice(cut), False
        elif count > 1_000_000:  # one anchor: what follows meets it by its contexts' rows
            yield settle(t, open_start, True)
            rest, open_start = t.slice(count), True
        else:
            rest = t
        held, count = rest.to_batches(), rest.num_rows
    if count:
        yield settle(pa.Table.from_batches(held), open_start, True)


def _window_hashes(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of windows, alike wherever the same bytes stand."""
    _, down = _powers.to(len(h))
    return _mixed((h[starts + length] - h[starts]) * down[starts])


def _parts_of(context: bytes, length: int, parts: int) -> list[int]:
    """Which of an anchor's tasks the windows of a context name."""
    if parts == 1:
        return [0]
    h = prefix_hashes(np.frombuffer(context, np.uint8))
    return np.unique(_window_hashes(h, np.arange(len(context) - length + 1), length) % np.uint64(parts)).tolist()


def _deal(a: int, part: int) -> int:
    x = (a + part * BASE) & MASK
    return x - (1 << 64) if x >> 63 else x


def _contexts(how: Repeats, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with lists of (a, lo, hi, parts, first): contexts that met here as settled spans, and each distinct one once."""
    seen: dict[tuple[int, bytes], list] = {}
    rows: list[tuple] = []
    size = 0

    def settled(a: int, doc, key: int, lo: int, hi: int) -> None:
        rows.append((key, a, 0, 1, doc, key, lo, hi, False, None, None))

    def emit() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(CONTEXTS)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, CONTEXTS, strict=True)], schema=CONTEXTS)

    def flush() -> Iterator[pa.RecordBatch]:
        held = 0
        for (a, context), (doc, key, lo, hi, parts, own, whole) in seen.items():
            # a class meets in the first of its parts; only what is compared with others goes to all of them
            deals, digest = _parts_of(context, how.length, parts), xxhash.xxh3_128_digest(context)
            sent = context if whole else context[: hi - lo + 1]
            for k in deals if whole else deals[:1]:
                rows.append((_deal(a, k), a, k, parts, doc, key, lo, hi, own, sent, digest))
                held += len(sent)
            if held > 4_000_000:
                yield emit()
                held = 0
        seen.clear()
        yield emit()

    for batch, texts in by_chunks(batches):
        docs, keys, needs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        for doc, key, t, own in zip(docs, keys, texts, needs, strict=True):
            starts = {need["lo"] for need in own}
            for need in own:
                a, lo, hi = need["a"], need["lo"], need["hi"]
                whole = need["first"] or hi + 1 not in starts
                context = t[lo : hi + how.length]
                met = seen.get((a, context))
                if met is None:
                    seen[a, context] = [doc, key, lo, hi, need["parts"], True, whole]
                    size += len(context)
                    continue
                met[6] |= whole
                if met[5]:
                    met[5] = False
                    settled(a, *met[:4])
                settled(a, doc, key, lo, hi)
            if size > how.held_bytes:
                yield from flush()
                size = 0
        if rows:
            yield emit()
    yield from flush()


class SuffixSorter:
    """Suffixes of a buffer, compared by binary search over prefix hashes."""

    def __init__(self, data: bytes):
        self.data = data
        self.h = prefix_hashes(np.frombuffer(data, np.uint8)).tolist()
        self.up = _powers.to(len(data) + 1)[0]

    def common(self, i: int, j: int, most: int) -> int:
        """The length of the common prefix of the suffixes at i and j, up to `most`."""
        if i > j:
            i, j = j, i
        h, shift = self.h, int(self.up[j - i])
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if ((h[i + mid] - h[i]) * shift - h[j + mid] + h[j]) & MASK:
                hi = mid - 1
            else:
                lo = mid
        return lo

    def sorted(self, starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(start, end of its context), in the order of the suffixes' bytes; Python's sort merges runs."""

        def compare(x: tuple[int, int], y: tuple[int, int]) -> int:
            most = min(x[1] - x[0], y[1] - y[0])
            n = self.common(x[0], y[0], most)
            if n == most:
                return (x[1] - x[0]) - (y[1] - y[0])
            return self.data[x[0] + n] - self.data[y[0] + n]

        return sorted(starts, key=cmp_to_key(compare))

    def verified(self, i: int, j: int, n: int) -> int:
        """How many of n bytes that hash alike are alike."""
        x, y = self.data[i : i + n], self.data[j : j + n]
        if x == y:
            return n
        return next(k for k in range(n) if x[k] != y[k])


def common_windows(group: list[int], contexts: list[bytes], length: int, part: list[int] | None = None, parts: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """By context, the spans covered by windows that another context of its group has as well. Groups come together; of a group
    that is dealt over several tasks, only the windows of this part count."""
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    at = np.cumsum(sizes) - sizes
    data = b"".join(contexts)
    if not data:
        return out
    # windows whose hash occurs again in their group; all others can't be common
    n_win = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), n_win)
    start = np.arange(int(n_win.sum())) - np.repeat(np.cumsum(n_win) - n_win, n_win) + at[owner]
    raw = _window_hashes(prefix_hashes(np.frombuffer(data, np.uint8)), start, length)
    if parts is not None and max(parts) > 1:
        mine = raw % np.asarray(parts, np.uint64)[owner] == np.asarray(part, np.uint64)[owner]
        raw, start, owner = raw[mine], start[mine], owner[mine]
    key = raw ^ (np.asarray(group, np.int64)[owner].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(order), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return out
    sorter = SuffixSorter(data)
    # the first windows of runs; the next round starts where the last one's extents end
    places, owners = start[again], owner[again]
    fresh = np.ones(len(places), bool)
    fresh[1:] = (places[1:] != places[:-1] + 1) | (owners[1:] != owners[:-1])
    stop = np.append(np.flatnonzero(fresh)[1:], len(places)) - 1
    pending = [(int(o), int(s), int(e)) for o, s, e in zip(owners[fresh], places[fresh], places[stop], strict=True)]
    # partners can be windows inside runs, so every start meets those windows of its group that hash like it
    ordered_start = start[order]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    block = np.cumsum(np.concatenate([[True], ~same])) - 1
    block_of = np.empty(len(order), np.int64)
    block_of[order] = block
    window_at = {int(p): i for p, i in zip(places, np.flatnonzero(again), strict=True)}
    while pending:
        by_block: dict[int, list[tuple[int, int, int]]] = {}
        for o, s, e in pending:
            by_block.setdefault(int(block_of[window_at[s]]), []).append((o, s, e))
        pending = []
        for b, items in by_block.items():
            lo = first[b]
            hi = first[b + 1] if b + 1 < len(first) else len(order)
            others = {int(s): int(owner[i]) for s, i in zip(ordered_start[lo:hi], order[lo:hi], strict=True)}
            ends = lambda s: int(at[others[s]] + sizes[others[s]])
            suffixes = sorter.sorted([(s, ends(s)) for s in others])
            rank = {s: i for i, (s, _) in enumerate(suffixes)}
            for o, s, e in items:
                i, best = rank[s], 0
                for j in (i - 1, i + 1):
                    if 0 <= j < len(suffixes):
                        t, t_end = suffixes[j]
                        n = sorter.common(s, t, min(ends(s) - s, t_end - t))
                        best = max(best, sorter.verified(s, t, n))
                if best >= length:
                    out[o].append((int(s - at[o]), int(s - at[o] + best)))
                    nxt = s + best - length + 1
                else:
                    nxt = s + 1
                if nxt <= e:
                    pending.append((o, nxt, e))
    return out


def equal_classes(contexts: list[bytes], sorter: SuffixSorter, at: list[int], digests: list[bytes], sizes: list[int]) -> list[list[int]]:
    """Contexts (at places `at` of the sorter's bytes) by classes of equal hashes and equal bytes, own part by own part (the
    first `sizes` bytes): sorted by the hashes of prefixes, neighbours verified."""
    by: dict[tuple[bytes, int], list[int]] = {}
    for i, key in enumerate(zip(digests, sizes, strict=True)):
        by.setdefault(key, []).append(i)
    out = []
    for (_, n), own in by.items():
        place = {at[i]: i for i in own}
        order = [place[s] for s, _ in sorter.sorted([(at[i], at[i] + n) for i in own])] if len(own) > 1 else own
        out.append([order[0]])
        for x, y in zip(order, order[1:], strict=False):
            if sorter.common(at[x], at[y], n) == n and sorter.verified(at[x], at[y], n) == n:
                out[-1].append(y)
            else:
                out.append([y])
    return out


def _resolve(how: Repeats, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor and part, the spans of common windows; settled spans pass."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        found: list[tuple] = []
        contexts = [r[9] for r in rows]
        sorter, at = SuffixSorter(b"".join(contexts)), np.cumsum([0, *map(len, contexts)]).tolist()
        mixed: list[tuple[int, list[int]]] = []
        first = 0
        while first < len(rows):
            last = first + 1
            while last < len(rows) and rows[last][1:3] == rows[first][1:3]:
                last += 1
            if last - first > 1:
                own = rows[first:last]
                classes = equal_classes(contexts[first:last], sorter, at[first:last], [r[10] for r in own], [r[7] - r[6] + 1 for r in own])
                for same in classes:
                    if len(same) > 1:
                        found += [(r[4], r[5], r[6], r[7] + how.length) for r in (own[i] for i in same) if r[8]]
                if len(classes) > 1:
                    # of each class a whole context, if it sent one to be compared
                    for same in classes:
                        mixed += [(first, [first + i for i in sorted(same, key=lambda i: -len(own[i][9]))])]
            first = last
        # one context of each class; those of a class met already, so only lone ones wait for windows
        mixed = [(g, same) for g, same in mixed if len(rows[same[0]][9]) >= rows[same[0]][7] - rows[same[0]][6] + how.length]
        lead = [same[0] for _, same in mixed]
        spans = common_windows([g for g, _ in mixed], [contexts[i] for i in lead], how.length, [rows[i][2] for i in lead], [rows[i][3] for i in lead])
        for (_, same), own in zip(mixed, spans, strict=True):
            r = rows[same[0]]
            if len(same) == 1 and r[8]:
                found += [(r[4], r[5], r[6] + x, r[6] + y) for x, y in own]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SPANS, strict=True)], schema=SPANS)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        done = batch.filter(batch.column(9).is_null())
        if done.num_rows:
            stop = np.asarray(done.column(7)) + how.length
            yield pa.RecordBatch.from_arrays([done.column(4), done.column(5), done.column(6), pa.array(stop, pa.int32())], schema=SPANS)
        for row in zip(*(c.to_pylist() for c in batch.filter(batch.column(9).is_valid()).columns), strict=True):
            if size > 400_000 and row[1:3] != held[-1][1:3]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[9])
    if held:
        yield settle(held)


def _by_row(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct(*fields)).alias("own"))


def _row_join(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    own = lists.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "own")
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_k")), how).select("doc_id", "row_key", "text", "own")


def row_spans(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """(doc_id, row_key, own) of the documents that lose something: the spans to remove, as structs of start and stop."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed_texts(docs)
    order = ["a", "c1", "c2", "doc_id", "row_key", "lo"]
    rows = map_arrow(texts, lambda batches: _anchor_rows(how, batches), ANCHORS)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = map_arrow(rows, _found, FOUND).checkpoint()
    # written out, so that the join below is one that Spark can split by a hot anchor's rows
    wide = found.filter("first").groupBy("a").agg(F.ceil(F.count("*") / how.per_group).cast("int").alias("parts")).filter("parts > 1").checkpoint()
    need = found.join(wide, "a", "left").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("a", "lo", "hi", F.coalesce("parts", F.lit(1)).alias("parts"), "first")).alias("own"))
    contexts = map_arrow(_row_join(texts, need, "inner"), lambda batches: _contexts(how, batches), CONTEXTS)
    contexts = contexts.repartition(parts, "deal").sortWithinPartitions("a", "part")
    return _by_row(map_arrow(contexts, lambda batches: _resolve(how, batches), SPANS), "start", "stop")


def with_spans(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """(doc_id, row_key, text, own): every document with its spans, or null."""
    return _row_join(keyed_texts(docs), row_spans(docs, how), "left")


def cut_spans(text: bytes, own: list[dict] | None) -> tuple[bytes, int]:
    """The text without the spans, and how many separate runs went."""
    if not own:
        return text, 0
    kept, at, runs, stop = [], 0, 0, -1
    for a, b in sorted((x["start"], x["stop"]) for x in own):
        if a > stop:
            kept.append(text[at:a])
            runs += 1
        stop = max(stop, b)
        at = stop
    return b"".join([*kept, text[at:]]), runs


def repeat_digests(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches):
            rows = [(len(t), *cut_spans(t, own)) for t, own in zip(texts, batch.column(3).to_pylist(), strict=True)]
            columns = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array([n - len(k) for n, k, _ in rows], pa.int64()), pa.array([r for _, _, r in rows], pa.int64()), pa.array([sha256(k).hexdigest() for _, k, _ in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=DIGESTS)

    return map_arrow(with_spans(docs, how), run, DIGESTS)


def remove_repeats(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """(doc_id, row_key, kept, n_removed): the remaining bytes of each document; a cut may fall inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_chunks(batches):
            kept = [cut_spans(t, own)[0] for t, own in zip(texts, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64())], schema=TEXTS)

    return map_arrow(with_spans(docs, how), run, TEXTS)
