"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.session import prepare

#: Bytes of text that a worker handles at once in numpy.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, with empty texts for nulls."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text): row_key tells rows that repeat a doc_id with another text apart."""
    d = doc_texts(docs)
    return d.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most `limit` bytes in `column` (or one longer text), and these texts as UTF-8."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if len(texts) > start:
            yield batch.slice(start), texts[start:]


def with_columns(batch: pa.RecordBatch, keep: list[str], schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of `schema`: the kept columns of `batch` and the given values."""
    arrays = []
    for f in schema:
        arrays.append(batch.column(batch.schema.get_field_index(f.name)).cast(f.type) if f.name in keep else pa.array(columns[f.name], f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def map_arrow(df: DataFrame, fn: Callable, schema: pa.Schema) -> DataFrame:
    """mapInArrow with the schema given once, as Arrow's."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return df.mapInArrow(fn, from_arrow_schema(schema))


def settled(df: DataFrame) -> DataFrame:
    """The rows, checkpointed and without the plan's estimates: a checkpoint keeps these, and the estimate of a join is a product,
    so over the rounds of an iteration its digits would double again and again."""
    spark, own = df.sparkSession, df.checkpoint()
    return type(df)(spark._jsparkSession.createDataFrame(own._jdf.javaRDD(), own._jdf.schema()), spark)


def release(spark: SparkSession, wait: float = 0.0) -> None:
    """Lets Spark delete the shuffle files and checkpoints of what is done. It does so when the driver's garbage is collected,
    which many small rounds may not bring about before their files have piled up. Python's side lets go of a plan about a
    second after its last use; `wait` is for that."""
    gc.collect()
    time.sleep(wait)
    spark._jvm.System.gc()


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_key"] == b["row_key"])
