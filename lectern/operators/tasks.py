"""From questions to answers with links into their documents, in one call."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import text as T
from lectern.operators import cites, grounding
from lectern.operators.embedding import RETRIES, Embedder, opened
from lectern.operators.retrieval import RetrievalConfig, attach_context
from lectern.sources.tables import stored

# Fixed value: cites by phrase that a model may still write.
_PHRASE_CITE = r"(?i)\[([^\]]{1,120})\]\(\s*(?:#(?:[a-z]+-cite-|cite-|e)?|cite:)[0-9]+\s*\)"


def without_marks(answer: Column) -> Column:
    """An answer without the marks that its model still wrote: numbers and sections go, phrases with a link keep their words."""
    out = F.regexp_replace(T.whole(answer), r"(?i)\[E?[0-9]+\](?!\()", "")
    return F.regexp_replace(F.regexp_replace(out, r"\[§[^\]]+\](?!\()", ""), _PHRASE_CITE, "$1")


def link_answers(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answers(answer_id, doc_id, answer) with ``linked``, ``tray``, ``n_claims`` and ``matched``, for every row.

    The claims of an answer are held against the sentences of its document; those that are supported get a link, and below the answer stands a
    list of the sentences. Blank answers, and those of documents without chunks, stay as they are, with 0 claims and an empty tray. answer_id is
    unique and not null.
    """
    c = F.col
    known = chunks.select("doc_id").distinct().withColumn("__known", F.lit(True))
    open_ = answers.join(known, "doc_id", "left").withColumn("__asked", F.coalesce("__known", F.lit(False)) & (T.trim(T.whole(c("answer"))) != "")).drop("__known")
    asked = open_.filter("__asked")
    # read three times below
    links = stored(grounding.ground_answers(asked.select("answer_id", "doc_id", "answer"), chunks))
    put = cites.insert_openings(asked.select("answer_id", without_marks(c("answer")).alias("answer")), cites.ground_links(links))
    trays = cites.ground_trays(links)
    counts = links.groupBy("answer_id").agg(F.count("*").alias("__matched"))
    rows = open_.join(put.withColumnRenamed("linked", "__linked").drop("answer"), "answer_id", "left").join(trays, "answer_id", "left").join(counts, "answer_id", "left")
    tray = F.coalesce("tray", F.lit(""))
    linked = F.when(c("__asked"), F.concat(c("__linked"), F.when(tray != "", F.concat(F.lit("\n\n"), tray)).otherwise(""))).otherwise(T.whole(c("answer")))
    claims = F.when(c("__asked"), F.size(grounding.claims(c("answer")))).otherwise(0)
    return rows.select(*answers.columns, linked.alias("linked"), tray.alias("tray"), claims.alias("n_claims"), F.coalesce("__matched", F.lit(0)).cast("int").alias("matched"))


def ask(asked: DataFrame, prompt: str, model: Embedder, out: str = "answer", batch: int = 8, retries: int = RETRIES) -> DataFrame:
    """asked with the model's answers, batch prompts at a time; a model is opened as in embedding.embed and gives pairs of index and text. Null prompts have none."""
    kept = [c for c in asked.columns if c != out]
    schema = asked.select(*kept).schema.add(out, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = opened(model)
        for found in batches:
            for at in range(0, found.num_rows, batch):
                rows = found.slice(at, batch)
                said = [t for t in rows.column(prompt).to_pylist() if t is not None]
                for attempt in range(retries + 1):
                    try:
                        got = dict(answer(said)) if said else {}
                        texts = iter([got[i] for i in range(len(said))])
                        break
                    except Exception as e:
                        if attempt == retries:
                            raise RuntimeError(f"{len(said)} prompts failed {retries + 1} times: {e}") from e
                column = pa.array([None if t is None else next(texts) for t in rows.column(prompt).to_pylist()], pa.string())
                yield pa.Table.from_batches([rows]).select(kept).append_column(out, column).combine_chunks().to_batches()[0]

    return asked.mapInArrow(run, schema)


def answer_questions(chunks: DataFrame, asked: DataFrame, titles: DataFrame, model: Embedder, config: RetrievalConfig = RetrievalConfig(), has_vectors: bool = False) -> DataFrame:
    """asked(query_id, doc_id, query, selection, bias, task) with used_rag, context_block, answer, linked, tray, n_claims and matched.

    Each question goes to the model with its context before it, where it has one; only answers to questions with context are linked. query_id is unique.
    """
    c = F.col
    ready = attach_context(chunks, asked, titles, config, has_vectors).withColumn("__prompt", F.concat_ws("\n\n", F.nullif(c("context_block"), F.lit("")), F.nullif(c("selection"), F.lit("")), "query"))
    # a written table, so that no question is asked twice
    said = stored(ask(ready, "__prompt", model).drop("__prompt"))
    used = link_answers(said.filter("used_rag").select(c("query_id").alias("answer_id"), "doc_id", "answer"), chunks).select(c("answer_id").alias("query_id"), "linked", "tray", "n_claims", "matched")
    rows = said.join(used, "query_id", "left")
    return rows.withColumns({"linked": F.coalesce("linked", T.whole(c("answer"))), "tray": F.coalesce("tray", F.lit("")), "n_claims": F.coalesce("n_claims", F.lit(0)), "matched": F.coalesce("matched", F.lit(0))})
