"""Labels from a remote model: requests, cost, calls row by row, and chunks that are submitted, polled and fetched."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens a record in and out, dollars per million of them, records a minute, a batch's share of the price.
TOKENS_IN, TOKENS_OUT, PRICE_IN, PRICE_OUT, PER_MINUTE, BATCH_SHARE = 500, 80, 0.80, 4.00, 90, 0.5


def requests(df: DataFrame, template: str, columns: tuple[str, ...], key: str = "record_id") -> DataFrame:
    """(record_id, prompt): `{name}` in the template stands for the row's column, empty where null. Rows without a key are left out."""
    rest, parts = template, []
    while rest:
        found = min(((rest.find("{" + c + "}"), c) for c in columns if "{" + c + "}" in rest), default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        at, c = found
        parts += [F.lit(rest[:at]), F.coalesce(F.col(c).cast("string"), F.lit(""))]
        rest = rest[at + len(c) + 2 :]
    return df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("record_id"), F.concat(*parts, F.lit("")).alias("prompt"))


def estimate_cost(df: DataFrame) -> DataFrame:
    """(records, dollars, batch_dollars, minutes) of labelling every row."""
    n = F.col("records")
    dollars = n * (TOKENS_IN * PRICE_IN + TOKENS_OUT * PRICE_OUT) / 1e6
    return df.agg(F.count("*").alias("records")).select("records", dollars.alias("dollars"), (dollars * BATCH_SHARE).alias("batch_dollars"), (n / PER_MINUTE).alias("minutes"))


ANSWERS = pa.schema([("record_id", pa.string()), ("response", pa.string()), ("error", pa.string())])


def call_model(asked: DataFrame, make_client: Callable[[], Callable[[str], str]], tries: int = 5, base_seconds: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(record_id, response, error): one client a task, waits doubled between tries; what fails at last is a row with its error.

    The number of partitions bounds the calls at once. A lost task's rows are asked again; write the result before using it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            said, errors = [], []
            for prompt in batch.column("prompt").to_pylist():
                answer = error = None
                for k in range(tries):
                    try:
                        answer, error = client(prompt), None
                        break
                    except Exception as e:  # whatever a client raises becomes the row's error
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < tries:
                            sleep(base_seconds * 2**k)
                said.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(said, pa.string()), pa.array(errors, pa.string())], schema=ANSWERS)

    return asked.select("record_id", "prompt").mapInArrow(run, "record_id string, response string, error string")


class RateLimited(Exception):
    """The service takes no more chunks for now."""


class Batches(Protocol):
    def submit(self, rows: DataFrame) -> str: ...
    def ended(self, batch_id: str) -> bool: ...
    def fetch(self, batch_id: str, path: str) -> None: ...


@dataclass
class Chunk:
    number: int
    state: str = "pending"
    batch_id: str | None = None
    error: str | None = None


@dataclass
class Manifest:
    chunks: list[Chunk] = field(default_factory=list)

    @classmethod
    def of(cls, n: int) -> Manifest:
        return cls([Chunk(i) for i in range(n)])

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Manifest:
        return cls([Chunk(**c) for c in json.loads(text)["chunks"]])

    @property
    def complete(self) -> bool:
        return all(c.state == "downloaded" for c in self.chunks)


def step(manifest: Manifest, service: Batches, asked: DataFrame, folder: str, save: Callable[[Manifest], None] = lambda m: None) -> Manifest:
    """Fetches what has ended, then submits what is pending; `asked` holds a column chunk, as write_chunks leaves it.

    A rate limit leaves this chunk and all later ones pending; another error leaves its chunk alone. The manifest is saved after
    each change; a driver lost between a change and its save repeats that one submission or fetch.
    """
    for c in manifest.chunks:
        if c.state == "submitted" and service.ended(c.batch_id):
            service.fetch(c.batch_id, f"{folder}/chunk={c.number}")
            c.state = "downloaded"
            save(manifest)
    for c in manifest.chunks:
        if c.state != "pending":
            continue
        try:
            c.batch_id = service.submit(asked.filter(F.col("chunk") == c.number).drop("chunk"))
        except RateLimited:
            break
        except Exception as e:
            c.error = f"{type(e).__name__}: {e}"
            continue
        c.state, c.error = "submitted", None
        save(manifest)
    return manifest
