"""Grounding of answers: each claim is matched to the sentence that supports it best.

A pair's score is half token precision, a quarter Jaccard and a quarter the longest common run, by native
array functions. Claims and sentences meet by shared tokens, not as all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import scoring
from lectern.operators.links import link_phrase
from lectern.sources.tables import stored

LEAST_PRECISION, LEAST_RUN, LEAST_SCORE = 0.28, 0.35, 0.42
CLAIM_LINE, CLAIM_MINIMUM, CLAIM_MAXIMUM, CLAIM_SPLIT = 220, 12, 240, 80
SENTENCE_MINIMUM, SENTENCE_MAXIMUM, SENTENCE_KEY, FEW_SENTENCES = 28, 420, 160, 8
PREFILTER, PREFILTER_ABOVE, MAX_LINKS = 20, 12, 6
# Markup, links, marks, bullets, numbers and questions, as claims are freed from them.
MARKUP, MARKDOWN_LINK, NUMBER_MARK, SECTION_MARK = "<[^>]+>", r"\[([^\]]+)\]\([^)]*\)", r"(?i)\[E?[0-9]+\]", r"\[§[^\]]+\]"
BULLET, NUMBERED, QUESTION = r"^\s*[-*•·]\s+", r"^\s*[0-9]+[.)]\s+", r"(?i)^(?:what|how|why|who|when|where|which)(?![A-Za-z0-9_])"
#: Shorter phrases are no links.
LINK_PHRASE = 4


def _clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.trim(F.left(text, F.lit(limit - 1))), F.lit("…"))).otherwise(text)


def claims(answer: Column) -> Column:
    """The claims of an answer in their order, array<string>: its lines without markup, marks and bullets, long ones by sentences; no wh-questions, none twice."""
    plain = F.regexp_replace(T.whole(answer), MARKUP, " ")
    plain = F.regexp_replace(plain, MARKDOWN_LINK, "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, NUMBER_MARK, " "), SECTION_MARK, " ")
    plain = T.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\S\n]+", " "), "\n{3,}", "\n\n"))

    def of(p):
        bare = lambda line: T.squeeze(F.regexp_replace(F.regexp_replace(line, BULLET, ""), NUMBERED, ""))
        cleaned = F.filter(F.transform(F.split(p, "\n+"), bare), lambda line: line != "")
        spans = F.flatten(F.transform(cleaned, lambda line: F.when(F.length(line) <= CLAIM_LINE, F.array(line)).otherwise(T.ground_sentences(line))))
        single = (F.size(spans) <= 1) & (F.length(p) > CLAIM_SPLIT)
        spans = F.when(single, F.concat(spans, F.array_except(T.ground_sentences(p), spans))).otherwise(spans)
        asks = lambda s: s.rlike(QUESTION) & s.endswith("?")
        kept = F.filter(spans, lambda s: (F.length(s) >= CLAIM_MINIMUM) & ~asks(s))
        return F.transform(_first_by(kept, T.normalize_match), lambda s: _clip(s, CLAIM_MAXIMUM))

    return F.when(plain == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.array(plain), of)[0])


def _first_by(values: Column, key) -> Column:
    """Values without those whose key an earlier one has."""
    return F.transform(F.array(F.struct(values.alias("v"), F.transform(values, key).alias("k"))), lambda s: F.filter(s["v"], lambda v, i: F.array_position(s["k"], key(v)) == i + 1))[0]


def precision(claim: Column, sentence: Column) -> Column:
    """Share of the claim's tokens that the sentence has; 0 with fewer than two tokens on a side."""
    hits = F.size(F.filter(claim, lambda t: F.array_contains(sentence, t)))
    return F.when((F.size(claim) < 2) | (F.size(F.array_distinct(sentence)) < 2), 0.0).otherwise(hits / F.size(claim))


def jaccard(a: Column, b: Column) -> Column:
    few = (F.size(F.array_distinct(a)) < 2) | (F.size(F.array_distinct(b)) < 2)
    return F.when(few, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def longest_run(claim: Column, sentence: Column) -> Column:
    """Length of the longest common run of tokens: a fold over the claim that keeps, for each place of the sentence, the run ending there."""
    zero = F.transform(sentence, lambda t: F.lit(0))
    start = F.struct(zero.alias("row"), F.lit(0).alias("best"))

    def step(s, token):
        row = F.transform(sentence, lambda t, j: F.when(t == token, F.coalesce(F.get(s["row"], j - 1), F.lit(0)) + 1).otherwise(0))
        return F.transform(F.array(row), lambda r: F.struct(r.alias("row"), F.greatest(s["best"], F.coalesce(F.array_max(r), F.lit(0))).alias("best")))[0]

    return F.aggregate(claim, start, step, lambda s: s["best"])


def run_share(claim: Column, sentence: Column) -> Column:
    few = (F.size(claim) < 2) | (F.size(sentence) < 2)
    return F.when(few, 0.0).otherwise(F.least(F.lit(1.0), longest_run(claim, sentence) / F.greatest(F.lit(2), F.least(F.size(claim), F.lit(8)))))


def combined(p: Column, j: Column, r: Column) -> Column:
    return F.when((p < LEAST_PRECISION) & (r < LEAST_RUN), 0.0).otherwise(F.least(F.lit(1.0), p * 0.5 + j * 0.25 + r * 0.25))


def sentence_corpus(chunks: DataFrame) -> DataFrame:
    """(doc_id, pos, text, section, page_start, chunk_id): the sentences of each document, none twice; parents' only where the finer chunks give few."""
    together = chunks.select("doc_id", "seq", "section", "page_start", "id", "kind", "anchor_text", "text").repartition("doc_id")

    def of(rows: DataFrame, pieces: Column, tier: int) -> DataFrame:
        # ground_sentences() are squeezed, and an anchor but for its ends; outer, as Spark would find the pieces a second time for a filter
        found = rows.select("doc_id", "seq", "section", "page_start", F.col("id").alias("chunk_id"), F.posexplode_outer(pieces).alias("i", "text"))
        return found.filter(F.length("text") >= SENTENCE_MINIMUM).withColumn("text", _clip(F.col("text"), SENTENCE_MAXIMUM)).withColumn("tier", F.lit(tier))

    def distinct(rows: DataFrame) -> DataFrame:
        key = F.left(F.lower("text"), F.lit(SENTENCE_KEY))
        return rows.withColumn("key", key).withColumn("__n", F.row_number().over(W.partitionBy("doc_id", "key").orderBy("tier", "seq", "i"))).filter("__n = 1").drop("__n", "key")

    fine = of(together.filter(F.col("kind").isin("child", "abstract")), F.concat(F.array(F.trim("anchor_text")), T.ground_sentences(F.col("text"))), 0)
    # read twice, so written once
    fine = stored(distinct(fine).withColumn("enough", F.count("*").over(W.partitionBy("doc_id")) >= FEW_SENTENCES))
    enough = fine.filter("enough").select("doc_id").distinct()
    coarse = of(chunks.filter("kind = 'parent'").join(enough, "doc_id", "left_anti"), T.ground_sentences(F.col("text")), 1)
    # of documents with enough none is a parent's, and all differ already
    every = fine.filter("enough").drop("enough").unionByName(distinct(fine.filter("not enough").drop("enough").unionByName(coarse)))
    return every.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("tier", "seq", "i"))).drop("tier", "seq", "i")


def best_sentences(claims_: DataFrame, sentences: DataFrame, scope: list[str]) -> DataFrame:
    """(claim keys, pos, score, phrase): for each claim(claim_id, claim, scope) the best sentence(pos, text, scope) of LEAST_SCORE up that shares a link phrase; the earliest of equals.

    Only sentences that share a token are scored. Of more than PREFILTER_ABOVE sentences in a scope, the PREFILTER best by
    BM25 are scored.
    """
    size = sentences.groupBy(*scope).agg(F.count("*").alias("n")) if scope else None
    ranked = scoring.bm25(sentences, ["pos"] if not scope else [*scope, "pos"], claims_.select(F.col("claim_id").alias("query_id"), *scope, F.col("claim").alias("query")), scope=scope, query_scope=scope)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos")
    near = ranked.withColumn("__n", F.row_number().over(order))
    if size is not None:
        near = near.join(size, scope).filter((F.col("__n") <= PREFILTER) | (F.col("n") <= PREFILTER_ABOVE))
    else:
        near = near.filter(F.col("__n") <= PREFILTER)
    pairs = near.select(F.col("query_id").alias("claim_id"), *scope, "pos").join(claims_, ["claim_id", *scope]).join(sentences, [*scope, "pos"])
    toks = pairs.withColumns({"c": T.tokens(F.col("claim")), "s": T.tokens(F.col("text"))})
    scored = toks.withColumn("score", F.round(combined(precision(F.col("c"), F.col("s")), jaccard(F.col("c"), F.col("s")), run_share(F.col("c"), F.col("s"))), 9)).filter(F.col("score") >= LEAST_SCORE)
    # only sentences with a phrase that stands in the claim can be the best; tokens are at hand, and the function runs once a pair
    scored = scored.withColumn("phrase", link_phrase(F.col("claim"), F.col("c"), F.col("s"))).filter("phrase is not null")
    best = W.partitionBy("claim_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n", "c", "s")


def links(matched: DataFrame, answer: list[str]) -> DataFrame:
    """The answer's links: the first claim of each sentence, none by a phrase under LINK_PHRASE characters, MAX_LINKS by claim order, ranked by score."""
    key = F.left(T.normalize_match(F.col("text")), F.lit(120))
    first = matched.filter(T.utf16_length(F.col("phrase")) >= LINK_PHRASE).withColumn("__key", key).withColumn("__n", F.row_number().over(W.partitionBy(*answer, "__key").orderBy("claim_no"))).filter("__n = 1")
    few = first.withColumn("__n", F.row_number().over(W.partitionBy(*answer).orderBy("claim_no"))).filter(F.col("__n") <= MAX_LINKS)
    return few.withColumn("rank", F.row_number().over(W.partitionBy(*answer).orderBy(F.desc("score"), "claim_no"))).drop("__n", "__key")


def ground_answers(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """The links of each answer(answer_id, doc_id, answer) into the chunks of its document: a row a link, with claim, phrase, sentence and score.

    Answers without a claim, and those of documents without chunks, have no rows.
    """
    spans = answers.select("answer_id", "doc_id", F.posexplode(claims(F.col("answer"))).alias("claim_no", "claim")).withColumn("claim_no", F.col("claim_no") + 1)
    corpus = sentence_corpus(chunks.join(answers.select("doc_id").distinct(), "doc_id", "left_semi"))
    best = best_sentences(spans.withColumn("claim_id", F.concat_ws("-", "answer_id", "claim_no")), corpus, ["doc_id"])
    return links(best, ["answer_id"]).select("answer_id", "doc_id", "rank", "claim_no", "claim", "phrase", "pos", "text", "section", "page_start", "score")
