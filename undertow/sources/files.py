"""Readers and writers of awards, ratings and result chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions.scalar import coerce_date, parse_currency


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as text, only '' as null; quoted fields may hold line feeds and doubled quotes; a leading byte order mark goes.

    A file whose fields may hold line feeds is read by one task; with multi_line=False files are split.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', nullValue="", emptyValue="", mode="PERMISSIVE")
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return df.select(*columns) if columns else df


def read_awards(spark: SparkSession, path: str | list[str], names: dict[str, str], money: tuple[str, ...] = ("dollars",), dates: tuple[str, ...] = ("effective_date",)) -> DataFrame:
    """The columns `names` (file's name to own name); money as doubles and dates as dates, null where they can't be read."""
    df = read_csv(spark, path)
    out = df.select(*[F.col(f"`{theirs}`").alias(own) for theirs, own in names.items()])
    for c in money:
        out = out.withColumn(c, parse_currency(c)) if c in out.columns else out
    for c in dates:
        out = out.withColumn(c, coerce_date(c)) if c in out.columns else out
    return out


def read_ratings(spark: SparkSession, path: str, rater: str, unit: str, label: str, options: list[str] | None = None, other: str = "Unspecified") -> DataFrame:
    """(unit_id, rater, label) of a rating sheet; labels outside `options` become `other`, empty ones stay null."""
    own = F.trim(F.col(f"`{label}`"))
    value = F.when(own.isNull() | own.isin(options), own).otherwise(other) if options else own
    return read_csv(spark, path).select(F.trim(F.col(f"`{unit}`")).alias("unit_id"), F.lit(rater).alias("rater"), value.alias("label"))


def write_chunks(df: DataFrame, path: str, n: int, key: str) -> None:
    """Rows in folders chunk=0 to n-1, by a hash of the key: a chunk keeps its rows whatever the order."""
    df.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).write.partitionBy("chunk").mode("errorifexists").parquet(path)


def read_chunks(spark: SparkSession, path: str, expected: list[int]) -> DataFrame:
    """All chunks in one table; raises if one is missing. Only partition names are looked at for that."""
    df = spark.read.parquet(path)
    # one row a chunk: bounded by the chunks that the caller lists
    there = {r.chunk for r in df.select("chunk").distinct().filter(F.col("chunk").isin(expected)).collect()}
    if missing := sorted(set(expected) - there):
        raise FileNotFoundError(f"missing chunks: {missing}")
    return df.filter(F.col("chunk").isin(expected))


def write_table(df: DataFrame, path: str, overwrite: bool = False, form: str = "parquet") -> None:
    """Refuses to replace what is there unless told to."""
    w = df.write.format(form).mode("overwrite" if overwrite else "errorifexists")
    (w.option("header", True).option("escape", '"') if form == "csv" else w).save(path)
