"""Vectors for texts from a model that answers in batches, and a hybrid ranking with them.

A model is anything with ``open()``, which gives a function from a list of texts to pairs of index and vector (in any order). It is opened
once for each Python worker, however many tasks that runs, and asked for BATCH texts at a time, whatever size Spark's own
batches have.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

Vector = Sequence[float]
Answer = Callable[[list[str]], Iterable[tuple[int, Vector]]]

# Texts of one request, and UTF-16 units of a text that it may hold.
BATCH, LIMIT = 32, 8000
#: Times a failed request is sent again, and seconds before the first of them; each wait is twice the one before.
RETRIES, WAIT = 2, 0.1


class Embedder(Protocol):
    """A model by name; equal names are one model to a worker."""

    name: str

    def open(self) -> Answer: ...


@dataclass(frozen=True)
class HashedWords:
    """Counts of a text's words in ``width`` cells by MD5: a model without weights, for tests and for texts of no known language."""

    width: int = 64

    @property
    def name(self) -> str:
        return f"hashed-words-{self.width}"

    def vector(self, text: str) -> list[float]:
        out = [0.0] * self.width
        for word in re.findall("[a-z0-9]+", text.lower()):
            out[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.width] += 1.0
        return out

    def open(self) -> Answer:
        return lambda texts: [(i, self.vector(t)) for i, t in enumerate(texts)]


_OPEN: dict[str, Answer] = {}


def opened(model: Embedder) -> Answer:
    """The worker's own instance of a model."""
    if model.name not in _OPEN:
        _OPEN[model.name] = model.open()
    return _OPEN[model.name]


def cut(text: str, limit: int) -> str:
    """At most so many UTF-16 units, no pair of them torn apart."""
    return text if len(text) * 2 <= limit else text.encode("utf-16-le", "surrogatepass")[: 2 * limit].decode("utf-16-le", "ignore")


def ask(answer: Answer, texts: list[str], retries: int = RETRIES, wait: float = WAIT) -> list[list[float]]:
    """The vectors of one request in the order of its texts. A request that fails is sent again; one with a text left out, or answered twice, has failed."""
    for attempt in range(retries + 1):
        try:
            got = sorted(answer(texts), key=lambda pair: pair[0])
            if [i for i, _ in got] != list(range(len(texts))):
                raise ValueError(f"{len(texts)} texts were asked for, {len(got)} vectors came")
            return [[float(x) for x in v] for _, v in got]
        except Exception as e:
            if attempt == retries:
                raise RuntimeError(f"a request of {len(texts)} texts failed {retries + 1} times: {e}") from e
            time.sleep(wait * 2**attempt)
    raise AssertionError


def embed(df: DataFrame, text: str, model: Embedder, batch: int = BATCH, limit: int = LIMIT, retries: int = RETRIES, out: str = "embedding") -> DataFrame:
    """df with ``out``, array<double>, and ``<out>_cut``, whether the text was longer than ``limit`` UTF-16 units and only its beginning was sent.

    Null texts have a null vector and aren't sent; empty ones are. Equal texts of a request are sent once. Rows keep their other columns; columns named
    as the new ones are replaced. An empty df gives no rows. A request that keeps failing fails the task, and Spark runs
    that anew.
    """
    if batch < 1 or limit < 1:
        raise ValueError("batch and limit: 1 or more")
    kept = [c for c in df.columns if c not in (out, f"{out}_cut")]
    schema = df.select(*kept).schema.add(out, ArrayType(DoubleType())).add(f"{out}_cut", BooleanType())

    def with_vectors(rows: pa.Table, answer: Answer) -> pa.RecordBatch:
        texts = rows.column(text).to_pylist()
        short = [None if t is None else cut(t, limit) for t in texts]
        once = list(dict.fromkeys(t for t in short if t is not None))
        found = dict(zip(once, ask(answer, once, retries) if once else [], strict=True))
        vectors = pa.array([None if t is None else found[t] for t in short], pa.list_(pa.float64()))
        longer = pa.array([t is not None and t != s for t, s in zip(texts, short, strict=True)], pa.bool_())
        return rows.select(kept).append_column(out, vectors).append_column(f"{out}_cut", longer).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, held = opened(model), None
        for found in batches:
            held = pa.Table.from_batches([found]) if held is None else pa.concat_tables([held, pa.Table.from_batches([found])])
            whole = held.num_rows // batch * batch
            for at in range(0, whole, batch):
                yield with_vectors(held.slice(at, batch), answer)
            held = held.slice(whole)
        if held is not None and held.num_rows:
            yield with_vectors(held, answer)

    # other columns stay in Arrow, so no type of theirs changes; the text may be one of the replaced columns
    return df.mapInArrow(run, schema)


def embed_units(chunks: DataFrame, model: Embedder, **options) -> DataFrame:
    """chunks with the vectors of their searched units, as retrieval's hybrid mode reads them; parents have none."""
    units = F.col("kind").isin("child", "abstract")
    asked = chunks.withColumn("__sent", F.when(units, F.col("text")))
    return embed(asked, "__sent", model, **options).drop("__sent", f"{options.get('out', 'embedding')}_cut")


def embed_queries(queries: DataFrame, model: Embedder, **options) -> DataFrame:
    """queries(query, selection, bias) with ``query_embedding``, the vector of all that they ask."""
    asked = queries.withColumn("__sent", F.concat_ws("\n", "query", "selection", "bias"))
    return embed(asked, "__sent", model, out="query_embedding", **options).drop("__sent", "query_embedding_cut")
