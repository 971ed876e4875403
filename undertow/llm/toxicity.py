"""A counterfactually regularised toxicity classifier: sparse logistic regression on words and word beginnings.

Training sentences that name a group are paired with a copy in which each identity term is swapped for another one of its kind;
the squared change of the score between the two is penalised, so a neutral mention of a group moves the score little. Terms are
given by language and swapped in all of them. A sentence that names no group gets a term put in, a different one in its copy, so
that what the terms' beginnings share with ordinary words is penalised as well; both kinds of pairs count alike as kinds,
however many there are. A pair is kept as what differs between its sides. `Model.pairs` says how many there were, by kind and
language; a fit without any raises an error. An L1 penalty keeps the weights of ordinary words at zero, so a long clean text
doesn't add up to a high score.

The model is fitted on at most about `max_train` labelled rows (chosen by a hash of doc_id, so the choice doesn't depend on
the tables' order), one for a doc_id, with `max_features` features each at most; rows whose crc32(doc_id as text) mod 3 is 1 are
never learned from. Every document is scored, on its whole text, from the set of its words; labels, lang, source and doc_id are
not inputs of a score.

Nulls and empty texts score the model's intercept. Repeated rows score alike; of labelled rows that share a doc_id one is learned
from, the one whose text has the smallest hash. Labels that conflict for one doc_id are taken by their maximum, null labels
count for nothing. Without labels of both classes every score is the share of toxic labels (0 if none). An empty table gives no
rows. Columns other than doc_id and text, and doc_id, toxic of the labels, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.common import by_chunks, doc_texts, keyed_texts, map_arrow, with_columns

#: Words that name groups of people, by language and kind; a term is swapped within its kind.
IDENTITY_TERMS = {
    "en": (
        ("woman", "man", "person"),
        ("women", "men", "people"),
        ("girl", "boy"),
        ("girls", "boys"),
        ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("immigrant", "native", "refugee", "foreigner"),
        ("immigrants", "natives", "refugees", "foreigners"),
        ("old", "young", "elderly"),
        ("blind", "deaf", "disabled"),
    ),
    "de": (
        ("frau", "mann", "person"),
        ("frauen", "männer", "menschen"),
        ("schwul", "lesbisch", "hetero", "queer"),
        ("muslim", "christ", "jude", "hindu", "buddhist", "atheist"),
        ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
        ("schwarze", "weiße", "asiaten", "europäer", "afrikaner"),
        ("einwanderer", "ausländer", "flüchtling", "einheimischer"),
        ("blind", "taub", "behindert"),
    ),
    "fr": (
        ("femme", "homme", "personne"),
        ("femmes", "hommes", "gens"),
        ("gay", "lesbienne", "hétéro", "bisexuel", "transgenre"),
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("noirs", "blancs", "asiatiques", "africains", "européens"),
        ("immigré", "étranger", "réfugié", "autochtone"),
        ("aveugle", "sourd", "handicapé"),
    ),
    "es": (
        ("mujer", "hombre", "persona"),
        ("mujeres", "hombres", "gente"),
        ("gay", "lesbiana", "heterosexual", "bisexual", "transgénero"),
        ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("negros", "blancos", "asiáticos", "africanos", "europeos"),
        ("inmigrante", "extranjero", "refugiado", "nativo"),
        ("ciego", "sordo", "discapacitado"),
    ),
}

SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
TRAIN_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("row_key", pa.int64()), ("label", pa.int64()), ("features", pa.binary()), ("gone", pa.binary()), ("come", pa.binary()), ("natural", pa.bool_()), ("language", pa.string())]
)


@dataclass(frozen=True)
class Toxicity:
    max_train: int = 10_000
    threshold: float = 0.7
    hash_bits: int = 20
    prefixes: tuple[int, ...] = (4, 5, 6)
    l1: float = 6e-3
    swap_penalty: float = 1.0
    positive_weight: float = 10.0
    rounds: int = 200
    min_documents: int = 3
    max_features: int = 8_000
    identity_terms: dict[str, tuple[tuple[str, ...], ...]] = field(default_factory=lambda: IDENTITY_TERMS)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    how: Toxicity = field(default_factory=Toxicity)
    #: (named in the text, language) -> pairs that the fit was penalised for
    pairs: dict[tuple[bool, str], int] = field(default_factory=dict)


STRIP = ".,;:!?\"'()[]{}<>*_-"


def words_of(text: bytes) -> set[str]:
    return {w.strip(STRIP) for w in text.decode("utf-8", "replace").lower().split()}


def features_of(word: str, how: Toxicity) -> list[int]:
    mask = (1 << how.hash_bits) - 1
    out = [zlib.crc32(b"w" + word.encode()) & mask]
    out += [zlib.crc32(b"p" + word[:n].encode()) & mask for n in how.prefixes if len(word) > n]
    return out


class Swapper:
    """Counterfactual pairs of a text's words: each term swapped for another of its kind, or a term put in."""

    def __init__(self, terms: dict[str, tuple[tuple[str, ...], ...]]):
        self.kinds = [(lang, kind) for lang, kinds in terms.items() for kind in kinds if len(kind) > 1]
        self.of: dict[str, tuple[str, tuple[str, ...]]] = {}
        for lang, kind in self.kinds:
            for t in kind:
                self.of.setdefault(t, (lang, kind))

    def __call__(self, words: set[str], seed: int) -> tuple[set[str], set[str], bool, str] | None:
        """Both sides, whether the text itself named a group, and the language of the terms."""
        named = sorted(words & self.of.keys())
        if named:
            other = set()
            for w in named:
                kind = self.of[w][1]
                other.add(kind[(kind.index(w) + 1 + seed % (len(kind) - 1)) % len(kind)])
            return words, (words - set(named)) | other, True, self.of[named[0]][0]
        if not self.kinds:
            return None
        lang, kind = self.kinds[seed % len(self.kinds)]
        i = seed // len(self.kinds) % len(kind)
        return words | {kind[i]}, words | {kind[(i + 1) % len(kind)]}, False, lang


def _pack(words: set[str], how: Toxicity) -> np.ndarray:
    return np.unique(np.array([f for w in words for f in features_of(w, how)], "<u4"))


def _featurise(how: Toxicity, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    swap = Swapper(how.identity_terms)
    for batch, texts in by_chunks(batches):
        rows = []
        for t in texts:
            words = words_of(t)
            own = _pack(words, how)
            pair = swap(words, zlib.crc32(t))
            gone = come = np.zeros(0, "<u4")
            natural, lang = False, None
            if pair:
                x, y, natural, lang = pair
                a, b = own if natural else np.union1d(own, _pack(x - words, how)), np.union1d(_pack(y - words, how), _pack(words & y, how) if natural else own)
                gone, come = np.setdiff1d(a, b), np.setdiff1d(b, a)
            # features are hashes, so the smallest ones are a fair choice
            rows.append((own[: how.max_features].tobytes(), gone.astype("<u4").tobytes(), come.astype("<u4").tobytes(), natural, lang))
        features, gone, come, natural, lang = zip(*rows, strict=True)
        yield with_columns(batch, ["doc_id", "row_key", "label"], TRAIN_SCHEMA, features=features, gone=gone, come=come, natural=natural, language=lang)


def held_out_column(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, how: Toxicity) -> DataFrame:
    """One row for each of about max_train labelled documents at most, none of them held out: label, features, and its pair."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("label")).filter("doc_id is not null and label is not null")
    own = own.filter(~held_out_column()).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = max(own.count(), 1)
    if total > how.max_train:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * how.max_train / total))
    # at most about max_train pairs of numbers: small enough for every executor
    own = F.broadcast(own)
    texts = keyed_texts(docs).join(own, "doc_id")
    # of rows that repeat a doc_id, one: only keys are moved for that, and only of the sample
    first = texts.groupBy("doc_id").agg(F.min("row_key").alias("row_key"))
    texts = texts.join(F.broadcast(first), ["doc_id", "row_key"]).select("doc_id", "row_key", "label", "text")
    rows = map_arrow(texts, lambda batches: _featurise(how, batches), TRAIN_SCHEMA)
    # equal rows are alike, so any of them
    return rows.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in TRAIN_SCHEMA.names[2:]))


class _Rows:
    """Sparse 0/1 rows, scaled by column; products go block by block, so that little is held beside the indices."""

    BLOCK = 1 << 20

    def __init__(self, packed: list[bytes], column_of: np.ndarray, scale: np.ndarray):
        lens, parts = np.zeros(len(packed), np.int64), []
        for i, p in enumerate(packed):
            own = column_of[np.frombuffer(p, "<u4")]
            parts.append(own[own >= 0])
            lens[i] = len(parts[-1])
        self.col = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(packed), dtype=np.int32), lens)
        self.n, self.scale = len(packed), scale

    def _blocks(self):
        for i in range(0, len(self.col), self.BLOCK):
            yield self.row[i : i + self.BLOCK], self.col[i : i + self.BLOCK]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, w = np.zeros(self.n), w * self.scale
        for row, col in self._blocks():
            out += np.bincount(row, weights=w[col], minlength=self.n)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.scale))
        for row, col in self._blocks():
            out += np.bincount(col, weights=r[row], minlength=len(self.scale))
        return out * self.scale


def fit(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> Model:
    """Accelerated proximal gradient on the driver, over the bounded sample."""
    rows = training_rows(docs, labels, how).toArrow()
    y = rows.column("label").to_numpy().astype(float)
    packed, gone, come = (rows.column(c).to_pylist() for c in ("features", "gone", "come"))
    natural, language = rows.column("natural").to_pylist(), rows.column("language").to_pylist()
    del rows
    size = 1 << how.hash_bits
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(size), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), how)
    df = np.zeros(size, np.int64)
    for p in packed:
        df[np.frombuffer(p, "<u4")] += 1
    used = np.flatnonzero(df >= how.min_documents)
    column_of = np.full(size, -1, np.int32)
    column_of[used] = np.arange(len(used))
    # frequent columns weigh less, so that one step size suits all
    scale = 1 / np.sqrt(df[used] / len(y))
    scale = np.minimum(scale, np.sqrt(len(y) / 50))
    x = _Rows(packed, column_of, scale)
    pairs = [i for i, lang in enumerate(language) if lang]
    counts = Counter((natural[i], language[i]) for i in pairs)
    if how.swap_penalty and not pairs:
        raise ValueError("no counterfactual pairs: no identity terms are given")
    # what a pair's sides differ in; kinds of pairs count alike, however many pairs each has
    x0, x1 = (_Rows([src[i] for i in pairs], column_of, scale) for src in (gone, come))
    by_kind = Counter(natural[i] for i in pairs)
    half = np.array([how.swap_penalty / by_kind[natural[i]] for i in pairs])
    weight = np.where(y > 0, how.positive_weight, 1.0)
    weight /= weight.sum()
    del packed, gone, come

    def slope(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        r = weight * (1 / (1 + np.exp(-np.clip(x.dot(w) + b, -40, 40))) - y)
        g = x.back(r)
        if pairs:
            d = 2 * half * (x0.dot(w) - x1.dot(w))
            g = g + x0.back(d) - x1.back(d)
        return g, float(r.sum())

    # the largest curvature, by power iteration
    v = np.full(len(used), 1 / np.sqrt(max(len(used), 1)))
    top = 1.0
    for _ in range(12):
        u = x.back(weight * x.dot(v)) / 4
        if pairs:
            d = 2 * half * (x0.dot(v) - x1.dot(v))
            u = u + x0.back(d) - x1.back(d)
        top = max(float(np.linalg.norm(u)), 1e-12)
        v = u / top
    step = 1 / (top * 1.1)
    w = np.zeros(len(used))
    b = float(np.log(max(weight @ y, 1e-9) / max(1 - weight @ y, 1e-9)))
    z, zb, t = w, b, 1.0
    for _ in range(how.rounds):
        g, gb = slope(z, zb)
        nw = z - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * how.l1, 0)
        nb = zb - min(step * 20, 2.0) * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = nw + (t - 1) / nt * (nw - w), nb
        w, b, t = nw, nb, nt
    full = np.zeros(size)
    full[used] = w * scale
    return Model(full, b, how, dict(counts))


class Scorer:
    """Scores texts; what a word is worth is kept. Most words have no feature with a weight."""

    def __init__(self, at: np.ndarray, value: np.ndarray, intercept: float, how: Toxicity):
        self.live, self.intercept, self.how = dict(zip(at.tolist(), value.tolist(), strict=True)), intercept, how
        self.hot: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: bytes) -> float:
        hot, live = self.hot, self.live
        words = words_of(text)
        if len(hot) > 500_000:
            hot.clear()
        for w in words.difference(hot):
            hot[w] = tuple(f for f in features_of(w, self.how) if f in live)
        # a feature counts once in a text, as in training
        z = self.intercept + sum(live[f] for f in sorted({f for w in words for f in hot[w]}))
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def _scorers(spark: SparkSession, model: Model):
    """Weights go out once; they are bounded by the number of hash buckets."""
    at = np.flatnonzero(model.weights)
    shared = spark.sparkContext.broadcast((at, model.weights[at]))
    intercept, how = model.intercept, model.how
    return lambda: Scorer(*shared.value, intercept, how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): one row per document, scored on its whole text."""
    scorer = _scorers(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer()
        for batch, texts in by_chunks(batches):
            yield with_columns(batch, ["doc_id"], SCORE_SCHEMA, score=list(map(own, texts)))

    return map_arrow(doc_texts(docs), run, SCORE_SCHEMA)


def score_udf(spark: SparkSession, model: Model):
    """The score of a text column, for use beside other columns."""
    scorer = _scorers(spark, model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scorer()
        for some in texts:
            yield pd.Series([own(t.encode("utf-8", "surrogatepass")) for t in some], dtype="float64")

    return of


def classify(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity()) -> DataFrame:
    """(doc_id, held_out, score, predicted): fits on the labels, then scores every document."""
    scored = score(docs, fit(docs, labels, how))
    return scored.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"))
