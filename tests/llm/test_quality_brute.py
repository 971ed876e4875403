"""Every column of the quality rules against plain counting; maximal repeats against all substrings of a text."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")

from undertow.llm import quality  # noqa: E402


def plain_repeats(w, shortest):
    """(covered words, longest) from every substring that occurs twice and can't be extended to either side."""
    covered, longest, n = set(), 0, len(w)
    places = {}
    for i in range(n):
        for k in range(shortest, n - i + 1):
            places.setdefault(tuple(w[i : i + k]), []).append(i)
    for s, at in places.items():
        if len(at) > 1:
            left = {w[i - 1] if i else ("start",) for i in at}
            right = {w[i + len(s)] if i + len(s) < n else ("end",) for i in at}
            if len(left) > 1 and len(right) > 1:
                longest = max(longest, len(s))
                for i in at:
                    covered.update(range(i, i + len(s)))
    return len(covered), longest


def plain(text, how):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    windows = {}
    for i in range(len(w) - how.window + 1):
        windows.setdefault(tuple(w[i : i + how.window]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(how.window)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    covered, longest = plain_repeats(w, how.shortest)
    failed = len(w) < how.min_words or 100 * len(again) > how.max_repeat_percent * len(w)
    kept = not failed and covered <= how.max_covered_fraction * len(w) and longest <= how.max_longest_repeat
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(again), failed, covered, longest, kept


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "a " * 60, "é x <b> #1 | $\n" * 5, "x\n\nx\n x\n"]
    for letters in (2, 3, 6, 40):
        for n in (5, 21, 60, 90):
            out.append(" ".join(f"w{rng.randrange(letters)}" for _ in range(n)))
    for gap in (40, 90, 200):
        p = [f"p{k}" for k in range(rng.randrange(8, 30))]
        fresh = [f"f{gap}x{k}" for k in range(gap)]
        out.append(" ".join(p + fresh + p) + "\nend")
        out.append(" ".join(["u", *p, "v", *fresh, "u", *p, "w"]))
    return [*out, out[7], out[7]]


@pytest.mark.parametrize("how", [quality.Rules(), quality.Rules(shortest=5), quality.Rules(window=4, shortest=6, min_words=8)])
def test_every_column(spark, how):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, texts()[8])]
    d = spark.createDataFrame([(i, t, i, 0) for i, t in rows], "doc_id long, text string, n_words long, kept int")
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_covered_words, r.longest_repeat, r.kept) for r in quality.quality_rules(d, how).collect()), key=key)
    want = sorted(((i, *plain(t, how)) for i, t in rows), key=key)
    assert got == want
    assert any(not r[6] and not r[9] for r in got) and any(r[9] for r in got)
    assert quality.quality_rules(d.filter("false"), how).count() == 0
