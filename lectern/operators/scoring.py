"""Lexical, dense and hybrid scores.

BM25 follows the usual formula with k1 = 1.2 and b = 0.75. Statistics are kept by ``scope`` columns: by document when
its chunks are the units (the engine's default), or over the whole corpus with an empty scope. Query terms are joined to postings
before these are counted, so a unit's tokens are never shuffled unless some query names them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources.tables import stored

K1, B = 1.2, 0.75
#: Terms of all queries up to which these, with their counts and weights, are broadcast.
FEW_TERMS = 200_000
DENSE_WEIGHT, LEXICAL_WEIGHT = 0.6, 0.4


def unit_tokens(units: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, toks array<string>, len long)"""
    out = units.select(*keys, T.tokens(F.col(text)).alias("toks"))
    return out.withColumn("len", F.size("toks").cast("long"))


def postings(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, term, tf, len): how often each term is in each unit."""
    return tokens.select(*keys, "len", F.explode("toks").alias("term")).groupBy(*keys, "len", "term").agg(F.count("*").alias("tf"))


def document_frequency(tokens: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, term, df): in how many units each term is."""
    return tokens.select(*scope, F.explode(F.array_distinct("toks")).alias("term")).groupBy(*scope, "term").agg(F.count("*").alias("df"))


def corpus_stats(tokens: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, n, avgdl)"""
    return tokens.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def exact_sum(value: Column) -> Column:
    """The sum of doubles in whole numbers of 2^-20 and of 2^-62, which is the same in any order: units with equal words have equal scores."""
    scaled = value * F.lit(float(2**20))
    high = F.floor(scaled).cast("long")
    low = F.round((scaled - high) * F.lit(float(2**42))).cast("long")
    return (F.sum(high) + F.sum(low) / F.lit(float(2**42))) / F.lit(float(2**20))


def bm25(units: DataFrame, keys: Sequence[str], queries: DataFrame, scope: Sequence[str] = (), text: str = "text", query_scope: Sequence[str] = ()) -> DataFrame:
    """(query_id, keys, score): BM25 of every unit that shares a term with a query(query_id, query[, query_scope]).

    A term that a query repeats counts repeatedly. query_scope: columns in which a query and its units agree.
    Queries are the small side. Without a scope, and of FEW_TERMS at most, they are broadcast and texts are dealt out by unit once: all
    that is counted and summed of a unit stays in its task, so neither postings nor their products with queries are shuffled.
    """
    all_keys = list(dict.fromkeys([*keys, *scope]))
    terms = queries.select("query_id", *query_scope, F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", *query_scope, "term").agg(F.count("*").alias("qtf"))
    few = not scope and terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    small = F.broadcast if few else lambda df: df
    tokens = unit_tokens(units.select(*all_keys, text).repartition(*keys) if few else units, all_keys, text)
    asked = terms.select("term").distinct()
    # outer: of the other Spark makes a filter that finds the tokens a second time; the null of a text without any is in no question
    posted = tokens.select(*all_keys, "len", F.explode_outer("toks").alias("term")).join(small(asked), "term", "left_semi").groupBy(*all_keys, "len", "term").agg(F.count("*").alias("tf"))
    df = posted.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    stats = corpus_stats(units.select(*scope, T.token_count(F.col(text)).alias("len")), scope)
    joined = posted.join(small(df), [*scope, "term"])
    joined = joined.join(stats, list(scope)) if scope else joined.join(F.broadcast(stats))  # one row
    average = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    length = F.greatest(F.col("len"), F.lit(1))
    gain = idf(F.col("n"), F.col("df")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * (length / average)))
    weighted = joined.select(*all_keys, "term", gain.alias("gain"))
    on = [*query_scope, "term"]
    return weighted.join(small(terms), on).groupBy("query_id", *keys).agg(exact_sum(F.col("gain") * F.col("qtf")).alias("score"))


def top_k(scored: DataFrame, by: Sequence[str], order: Sequence[str], k: int, score: str = "score", digits: int = 9) -> DataFrame:
    """The k best rows of each group with their rank; scores are rounded first, so that ties break by ``order`` alone."""
    rounded = scored.withColumn(score, F.round(score, digits))
    window = W.partitionBy(*by).orderBy(F.desc(score), *order)
    return rounded.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def min_max(score: Column, window) -> Column:
    """Scaled to 0..1 in a window; all equal scores give 0."""
    low, high = F.min(score).over(window), F.max(score).over(window)
    return (score - low) / F.when(high - low == 0, F.lit(1e-9)).otherwise(high - low)


def min_max_by(scored: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """scored, its score scaled to 0..1 in each group as min_max() does. Groups are few: their bounds are broadcast, so rows are neither shuffled nor sorted; they are written once."""
    c, rows = F.col, stored(scored)
    bounds = rows.groupBy(*by).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    same = [c(f"__rows.{k}").eqNullSafe(c(f"__bounds.{k}")) for k in by]
    span = c("__high") - c("__low")
    scaled = ((c(f"__rows.{score}") - c("__low")) / F.when(span == 0, F.lit(1e-9)).otherwise(span)).alias(score)
    return rows.alias("__rows").join(F.broadcast(bounds).alias("__bounds"), same).select(*[scaled if k == score else c(f"__rows.{k}") for k in scored.columns])


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter of two vectors; 0 where one has no length. Null vectors count as empty."""
    none = F.expr("cast(array() as array<double>)")
    n = F.least(F.size(F.coalesce(a, none)), F.size(F.coalesce(b, none)))
    cut = lambda v: F.slice(F.coalesce(v.cast("array<double>"), none), F.lit(1), n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(cut(a), cut(b), lambda x, y: x * y))
    norm = lambda v: F.sqrt(total(F.transform(cut(v), lambda x: x * x)))
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot / lengths).otherwise(0.0)


def vector_norm(v: Column) -> Column:
    """The length of a vector, as cosine() takes it."""
    return F.sqrt(F.aggregate(F.transform(v.cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine_with(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """cosine() of vectors whose lengths are at hand: these are found once a vector, not once a pair. Vectors of two widths, and null ones, are left to cosine()."""
    dot = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.when(norm_a * norm_b > 0, dot / (norm_a * norm_b)).otherwise(0.0)).otherwise(cosine(a, b))


def hybrid(dense: Column, lexical: Column) -> Column:
    return DENSE_WEIGHT * dense + LEXICAL_WEIGHT * lexical
