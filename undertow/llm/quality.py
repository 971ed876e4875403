"""Quality rules from repetition: base counts, and a suffix array over each text's words.

The longest-common-prefix intervals of a suffix array of word ids give the maximal repeats: an interval's suffixes share its
prefix, no longer one, and the words before them differ. The union of their spans is the covered part of a text, the longest of
them its longest repeat; both have limits of their own, below those of the base rule. Repeats count from `shortest` words on.
Only suffixes whose first `shortest` words occur again in the same text can share that many words with another suffix, so only
these are sorted; the others' common prefixes are shorter. Texts are handled in chunks of bounded size, many short texts at
once; a document's index leads the sort key, so that no repeat crosses documents. A very long text is a chunk of its own.

Nulls and empty texts have no words: every count is 0 and base_failed is true. A text of one repeated word is one run whose
windows all repeat. Repeated rows are judged on their own, one result each; so are ties, as documents never meet. An empty
table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from undertow.llm.common import by_chunks, doc_texts, map_arrow, with_columns

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
     ("base_failed", pa.bool_()), ("n_covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("kept", pa.bool_())]
)


@dataclass(frozen=True)
class Rules:
    """Limits on a text.

    window, min_words and max_repeat_percent are the base rule's. Maximal repeats count from `shortest` words on: they may cover
    max_covered_fraction of the words, and none may be longer than max_longest_repeat words."""

    window: int = 8
    shortest: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    max_covered_fraction: float = 0.12
    max_longest_repeat: int = 50


def _suffix_array(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, dup: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, their order as suffixes, and the common prefixes of neighbours in that order, for positions that include `dup`.

    ids, doc, end: by word, its id, its document and that document's end. Ranks by window, twice the window, four times the
    window... are kept, so that the common prefix of neighbours in suffix order is found from the largest power down.
    """
    n = len(ids)
    nxt = dup + window
    nxt = nxt[nxt < end[dup]]
    pos = np.unique(np.concatenate([dup, nxt]))
    where = np.full(n + 1, -1, np.int64)
    where[pos] = np.arange(len(pos))
    cols = np.full((window, len(pos)), -1, np.int64)
    for k in range(window):
        inside = pos + k < end[pos]
        cols[k, inside] = ids[pos[inside] + k]
    keys = [*cols[::-1], doc[pos]]
    order = np.lexsort(keys)
    step = np.zeros(len(pos), bool)
    for c in keys:
        s = c[order]
        step[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(pos), np.int64)
    rank[order] = np.cumsum(step)
    levels, h = [rank], window
    while True:
        counts = np.bincount(rank)
        if counts.max(initial=0) < 2:
            break
        tied = np.flatnonzero(counts[rank] > 1)
        at = pos[tied] + h
        second = np.full(len(tied), -1, np.int64)
        inside = at < end[pos[tied]]
        w = where[at[inside]]
        second[inside] = np.where(w >= 0, rank[w], -1)
        order = np.lexsort([second, rank[tied]])
        t, r, s = tied[order], rank[tied][order], second[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = r[1:] != r[:-1]
        split = fresh.copy()
        split[1:] |= s[1:] != s[:-1]
        if split.sum() == fresh.sum() and not inside.any():
            break
        # new ranks: the place of the run within its old rank's block, so that old order is kept
        new = rank * 1
        base = np.concatenate([[0], np.cumsum(counts)])[:-1]
        new = base[rank]
        run = np.cumsum(split) - 1
        first_of_run = np.flatnonzero(split)
        first_of_block = np.flatnonzero(fresh)
        block = np.cumsum(fresh) - 1
        new[t] = base[r] + (first_of_run[run] - first_of_block[block])
        rank = np.unique(new, return_inverse=True)[1]
        h *= 2
        levels.append(rank)
        if h > n:
            break
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    alive = doc[pos[a]] == doc[pos[b]]
    for k in range(len(levels) - 1, -1, -1):
        pa_, pb_ = pos[a] + lcp, pos[b] + lcp
        ok = alive & (pa_ < end[pos[a]]) & (pb_ < end[pos[b]])
        wa, wb = where[np.where(ok, pa_, n)], where[np.where(ok, pb_, n)]
        ok &= (wa >= 0) & (wb >= 0)
        same = ok & (levels[k][wa] == levels[k][wb])
        # ranks treat the end of a text as a symbol, so equal ranks of different positions span whole words
        lcp = np.where(same, lcp + (window << k), lcp)
    for _ in range(window - 1):
        pa_, pb_ = pos[a] + lcp, pos[b] + lcp
        ok = alive & (pa_ < end[pos[a]]) & (pb_ < end[pos[b]])
        same = ok & (ids[np.where(ok, pa_, 0)] == ids[np.where(ok, pb_, 0)])
        alive &= same
        lcp += same
    return pos, order, lcp


def maximal_repeats(before: np.ndarray, lcp: np.ndarray, shortest: int) -> np.ndarray:
    """By suffix (in order), the length of the longest maximal repeat that begins there, or 0.

    before: the word in front of each suffix, a value of its own where there is none. The intervals of lcp are a tree; one whose
    suffixes all follow the same word is no maximal repeat, as it goes on to the left, and its suffixes are asked of its parent.
    """
    out = np.zeros(len(before), np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (lcp >= shortest).astype(np.int8), [0]])))
    for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        common, words = lcp[first:stop].tolist(), before[first : stop + 1].tolist()
        length, parent, diverse, word = [], [], [], []  # by interval
        inner = [-1] * len(words)  # by suffix, its smallest interval
        stack: list[int] = []

        def meet(node: int, other, many: bool) -> None:
            diverse[node] = diverse[node] or many or word[node] != other

        for i, n in enumerate(common):
            last = -1
            while stack and length[stack[-1]] > n:
                last = stack.pop()
                if stack and length[stack[-1]] >= n:
                    parent[last] = stack[-1]
                    meet(stack[-1], word[last], diverse[last])
            if not stack or length[stack[-1]] < n:
                node = len(length)
                length.append(n)
                parent.append(-1)
                if last >= 0:
                    parent[last] = node
                    diverse.append(diverse[last])
                    word.append(word[last])
                else:
                    diverse.append(False)
                    word.append(words[i])
                    inner[i] = node
                stack.append(node)
            meet(stack[-1], words[i + 1], False)
            inner[i + 1] = stack[-1]
        while len(stack) > 1:
            last = stack.pop()
            parent[last] = stack[-1]
            meet(stack[-1], word[last], diverse[last])
        best = [0] * len(length)
        for node in sorted(range(len(length)), key=length.__getitem__):  # parents are shorter
            best[node] = length[node] if diverse[node] else best[parent[node]] if parent[node] >= 0 else 0
        out[first : stop + 1] = [best[k] for k in inner]
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    diff = np.zeros(n + 1, np.int64)
    np.add.at(diff, starts, 1)
    np.add.at(diff, starts + lengths, -1)
    return np.cumsum(diff[:-1]) > 0


def repetition(words: list[list[bytes]], window: int = 8, shortest: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: words in windows that occur again, words covered by maximal repeats of `shortest` words or more, the longest repeat."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lens.sum())
    zero = np.zeros(len(words), np.int64)
    if not n:
        return zero, zero.copy(), zero.copy()
    known: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter((known[w] for t in words for w in t), np.int64, n)
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(words)), lens)
    end = np.repeat(ends, lens)
    # candidates: windows with equal 64-bit hashes; the suffix array below compares the words themselves
    rng = np.random.default_rng(12345)
    word_hash = rng.integers(1, 2**63, len(known), np.uint64) * np.uint64(2) + np.uint64(1)
    h, x = np.zeros(n, np.uint64), word_hash[ids]
    least = min(window, shortest)
    for k in range(least):
        h[: n - k] = h[: n - k] * np.uint64(0x9E3779B97F4A7C15) + x[k:] if n > k else h[:0]
    h ^= (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    valid = np.flatnonzero(np.arange(n) + least <= end)
    order = valid[np.argsort(h[valid], kind="stable")]
    s = h[order]
    eq = s[1:] == s[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= eq
    twice[:-1] |= eq
    dup = np.sort(order[twice])
    if not len(dup):
        return zero, zero.copy(), zero.copy()
    pos, order, lcp = _suffix_array(ids, doc, end, dup, least)
    at = pos[order]
    shared = np.zeros(len(at), np.int64)
    shared[1:] = lcp
    shared[:-1] = np.maximum(shared[:-1], lcp)
    again = at[shared >= window]
    in_window = _covered(again, np.full(len(again), window), n)
    before = np.where((at > 0) & (doc[np.maximum(at, 1) - 1] == doc[at]), ids[np.maximum(at, 1) - 1], -1 - at)
    length = maximal_repeats(before, lcp, shortest)
    at, length = at[length > 0], length[length > 0]
    in_repeat = _covered(at, length, n)
    most = zero.copy()
    np.maximum.at(most, doc[at], length)
    return np.bincount(doc[in_window], minlength=len(words)), np.bincount(doc[in_repeat], minlength=len(words)), most


def _judge(rules: Rules, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in by_chunks(batches):
        words = [t.split() for t in texts]
        repeat, covered, longest = repetition(words, rules.window, rules.shortest)
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        chars, symbols, dup_lines = [], [], []
        for t in texts:
            chars.append(len(t.decode("utf-8", "replace")) - sum(t.count(c) for c in WHITE))
            symbols.append(sum(t.count(c) for c in SYMBOLS))
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup_lines.append(len(lines) - len(set(lines)))
        failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
        kept = ~failed & (covered <= rules.max_covered_fraction * n_words) & (longest <= rules.max_longest_repeat)
        yield with_columns(
            batch, ["doc_id"], SCHEMA, n_words=n_words, word_chars=chars, n_symbols=symbols, n_dup_lines=dup_lines, n_repeat_words=repeat, base_failed=failed,
            n_covered_words=covered, longest_repeat=longest, kept=kept,
        )


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document with its counts and the verdict; no shuffle."""
    return map_arrow(doc_texts(docs), lambda batches: _judge(rules, batches), SCHEMA)
