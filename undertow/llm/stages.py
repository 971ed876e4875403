"""Operators as stages of a corpus pipeline: documents in, documents out, with all their columns.

Each stage takes and returns the columns of its input; text is replaced by what the stage leaves of it, and n_chars, where
there is one, by its new length. Rows are never lost but by a stage's own decision. Helper columns get names that the input
doesn't have.

Null texts count as empty; stages that rewrite texts return them as empty. Very long texts are handled whole. Repeated rows stay,
each by its own decision, until near copies go, which leaves one of them. An empty table gives an empty one. Extra columns pass.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.llm import lines, nearcopies, packing, substrings, toxicity
from undertow.llm.common import text_or_empty
from undertow.session import prepare

def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until the input has none like them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        out.append(n)
    return out


def _keyed(docs: DataFrame, d: str, k: str) -> DataFrame:
    own = docs.withColumn(d, F.col("doc_id").cast("long"))
    return own.withColumn(k, F.xxhash64(F.col(d), text_or_empty("text")))


def _with_text(rows: DataFrame, columns: list[str], text) -> DataFrame:
    out = rows.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    how = toxicity.Toxicity()
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.score_udf(spark, toxicity.fit(docs, labels, how))
    return docs.filter(score(text_or_empty("text")) < how.threshold)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share, but for the first occurrence of each, by doc_id and position; rows
    that repeat it as a whole keep it as well."""
    prepare(spark)
    d, k, own, uid, key, bitmap = _free(docs, "d", "k", "own", "uid", "key", "bitmap")
    maps = lines.keep_bitmaps(docs, lines.LineRule(keep_first=True)).select(F.col("uid").alias(uid), F.col("row_key").alias(key), F.col("keep_bitmap").alias(bitmap))
    rows = _keyed(docs, d, k).withColumn(own, F.coalesce(d, k))
    rows = rows.join(maps, (F.col(own) == F.col(uid)) & (F.col(k) == F.col(key)), "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([lines.kept_lines(t.encode("utf-8", "surrogatepass"), b)[0].decode("utf-8", "replace") for t, b in zip(text, bitmap, strict=True)], dtype=object)

    return _with_text(rows, docs.columns, kept(text_or_empty("text"), F.col(bitmap)))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more): the one with the smallest
    doc_id; of rows that repeat its id and text the one whose columns have the smallest hash."""
    prepare(spark)
    d, k, stay, key, n = _free(docs, "d", "k", "stay", "key", "n")
    left = nearcopies.representatives(docs).select(F.col("doc_id").alias(stay), F.col("row_key").alias(key))
    rows = _keyed(docs, d, k)
    rows = rows.join(left, F.col(d).eqNullSafe(F.col(stay)) & (F.col(k) == F.col(key)), "left_semi")
    first = Window.partitionBy(d, k).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    return rows.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start anywhere else as well; pieces of characters at a cut go, too."""
    prepare(spark)
    d, k, doc, key, own = _free(docs, "d", "k", "doc", "key", "own")
    spans = substrings.row_spans(docs).select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("own").alias(own))
    rows = _keyed(docs, d, k)
    rows = rows.join(spans, F.col(d).eqNullSafe(F.col(doc)) & (F.col(k) == F.col(key)), "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, own, strict=True):
            out.append(substrings.cut_spans(t.encode("utf-8", "surrogatepass"), None if spans is None else list(spans))[0].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    return _with_text(rows, docs.columns, kept(text_or_empty("text"), F.col(own)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
