"""Language identification by compression (operator 5).

A text belongs to the language whose raw-content Zstandard dictionary encodes it in the fewest
bytes. The content is the words of a bounded sample of labelled texts, the most frequent last, where
they are cheapest to point to; a prediction reads nothing but the text. Before encoding, texts are
lower-cased and all but letters becomes single spaces. They are encoded whole, in blocks of ``BLOCK_BYTES`` so that the dictionary counts for the
last block of a long text as much as for the first. The score is the margin by which the second
best language needs more bytes; predictions with a margin under ``REJECT_BELOW`` are rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import table

#: Labelled texts of a language in the sample at most: one from each cell of a hash of the key.
CELLS = 512
#: Bytes of a dictionary at most: the most frequent words of the sampled texts, which are read whole.
DICT_BYTES = 20_000
BLOCK_BYTES = 4096
REJECT_BELOW = 0.001
UNDETERMINED = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    contents: tuple[bytes, ...]


def train(labelled: DataFrame, key: str, text: str, lang: str) -> Model:
    """Dictionaries from labelled rows; null languages and texts without a letter are left out.

    The sample is one row for each language and cell, the one with the least hash, so it is the same on each
    run, and a hot language or source takes no more room than another.
    """
    draw = F.xxhash64(F.lit("langid"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("name"), F.col(text).alias("content"), draw.alias("draw")).withColumn("cell", F.pmod("draw", F.lit(CELLS)).cast("int"))
    picks = rows.groupBy("name", "cell").agg(F.min("draw").alias("draw"))
    # repeated rows of one key are one; equal draws differ in the content
    sample = rows.join(F.broadcast(picks), ["name", "cell", "draw"]).groupBy("name", "cell", "draw").agg(F.min("content").alias("content"))
    counted = sample.select("name", "content").mapInPandas(_word_counts, "name string, word string, n long").groupBy("name", "word").agg(F.sum("n").alias("n"))
    # the most frequent words, as many as a dictionary holds
    size = F.sum(F.octet_length("word") + 1).over(W.partitionBy("name").orderBy(F.desc("n"), F.desc("word")).rowsBetween(W.unboundedPreceding, 0))
    found: dict[str, list[str]] = {}
    for r in counted.withColumn("upto", size).filter(F.col("upto") < DICT_BYTES).orderBy("name", "n", "word").select("name", "word").collect():
        found.setdefault(r["name"], []).append(r["word"])
    names = sorted(found)
    return Model(tuple(names), tuple(f" {' '.join(found[n])} ".encode("utf-8", "replace") for n in names))


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n = Counter((name, w) for name, t in zip(batch["name"], batch["content"], strict=True) for w in _plain(t).split())
        yield pd.DataFrame([(name, w.encode("utf-8", "replace").decode(), c) for (name, w), c in n.items()], columns=["name", "word", "n"])


def _plain(text: str) -> str:
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "


def _sizes(data: bytes, compressors: list) -> list[int]:
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def _predictor(model: Model):
    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        params = zstd.ZstdCompressionParameters.from_level(3, strategy=zstd.STRATEGY_LAZY2, min_match=3, search_log=4, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        compressors = [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params) for c in model.contents]
        plain = zstd.ZstdCompressor(compression_params=params)
        for series in texts:
            out = []
            for text in series:
                if not model.names or not text or not any(map(str.isalpha, text)):
                    out.append((UNDETERMINED, 0.0))
                    continue
                data = _plain(text).encode("utf-8", "replace")
                sizes = _sizes(data, compressors)
                best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
                rest = [s for i, s in enumerate(sizes) if i != best] or _sizes(data, [plain])
                out.append((model.names[best], max(0.0, 1 - sizes[best] / min(rest))))
            yield pd.DataFrame({"lang_pred": pd.Series([x for x, _ in out], dtype=object), "score": pd.Series([x for _, x in out], dtype=float)})

    return predict


def identify(df: DataFrame, text: str, model: Model) -> DataFrame:
    """df with lang_pred, score and rejected.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null, empty or without a letter, or
    nothing was learned. rejected: undetermined, or a score under REJECT_BELOW. Of equal sizes the first name wins
    (with score 0, hence rejected). With a single language the margin is over an encoding without dictionary.
    Columns of df with these names are replaced.
    """
    out = df.drop("lang_pred", "score", "rejected").withColumn("__found", _predictor(model)(F.col(text)))
    return out.select("*", "__found.lang_pred", "__found.score").drop("__found").withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < REJECT_BELOW))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame) -> Model:
    return train(docs.filter(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), "text", fit_on(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
