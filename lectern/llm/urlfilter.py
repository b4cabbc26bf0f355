"""URL filtering (operator 10): rules first, then gradient-boosted trees on lexical features.

The trees (Spark ML) are trained on all labelled URLs and on nothing but the URL's
letters: lengths, depth, digit ratio, entropy, parameter counts and statistics of its suffix.
Features are native columns; scoring is a map over the URLs, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import ascii_lower, cut, table

TREES = 20
DEPTH = 4
#: A suffix' block rate counts this many URLs of the average rate besides its own.
PRIOR = 10.0
BLOCK_FROM = 0.5

#: The rules (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words in a host that label a URL as unwanted for training.
UNWANTED = ("adult", "bet", "bets", "bingo", "casino", "erotic", "gambling", "lottery", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")

FEATURES = (
    "length", "host_length", "path_length", "query_length", "labels", "depth", "parameters", "digit_ratio", "host_digit_ratio",
    "hyphens", "host_hyphens", "longest_label", "entropy", "host_entropy", "upper_ratio", "percent_signs", "https", "suffix_share", "suffix_rate",
)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when((c == "") | (share(c) <= 0), 0.0).otherwise(share(c) * F.log2(share(c))))


def features(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with the columns of FEATURES but the suffix statistics, and suffix: the last two labels of the host."""
    u = F.coalesce(F.col(url), F.lit(""))
    h, p = host(u), path(u)
    q = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda c, regex: F.regexp_count(c, F.lit(regex))
    labels = F.split(h, r"\.")
    columns = {
        "length": F.length(u), "host_length": F.length(h), "path_length": F.length(p), "query_length": F.length(q),
        "labels": F.size(labels), "depth": count(p, "/[^/]"), "parameters": count(q, "[^&]+"),
        "digit_ratio": count(u, "[0-9]") / n, "host_digit_ratio": count(h, "[0-9]") / F.greatest(F.length(h), F.lit(1)),
        "hyphens": count(u, "-"), "host_hyphens": count(h, "-"), "longest_label": F.array_max(F.transform(labels, F.length)),
        "entropy": _entropy(u), "host_entropy": _entropy(h), "upper_ratio": count(u, "[A-Z]") / n, "percent_signs": count(u, "%"),
        "https": u.startswith("https:").cast("int"),
    }
    return urls.withColumns({k: v.cast("double") for k, v in columns.items()}).withColumn("suffix", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))


class UrlModel:
    """Trees and suffix statistics of the labelled URLs; suffixes: a row a suffix."""

    def __init__(self, trees, suffixes: DataFrame, rate: float):
        self.trees, self.suffixes, self.rate = trees, suffixes, rate

    def score(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """urls with ``block_score``, the probability that a URL is unwanted. A null URL is scored as an empty one; repeated rows score alike."""
        kept = [c for c in urls.columns if c != "block_score"]
        plain = urls.select(F.struct(*[F.col(c) for c in kept]).alias("__row"), F.col(url).alias("__url"))
        ready = _with_suffix(features(plain, "__url"), self.suffixes, self.rate)
        scored = self.trees.transform(_assembler().transform(ready))
        from pyspark.ml.functions import vector_to_array

        return scored.select(*[F.col("__row")[c].alias(c) for c in kept], vector_to_array("probability")[1].alias("block_score"))


def _with_suffix(rows: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    # as many suffixes as hosts, so Spark decides how they travel
    return rows.join(suffixes, "suffix", "left").fillna({"suffix_share": 0.0, "suffix_rate": rate})


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")


def train(labelled: DataFrame, url: str = "url", label: str = "label") -> UrlModel | None:
    """A model from URLs with label 1 (unwanted) or 0; None if there are not both.

    All distinct URLs are learned from; of one with both labels the greater counts. Null URLs or labels are left out.
    """
    distinct = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).dropna().groupBy("url").agg(F.max("label").alias("label"))
    known = cut(features(distinct).drop("url"))
    n, rate = known.agg(F.count("*"), F.avg("label")).first()
    if not n or rate in (0.0, 1.0):
        return None
    by_suffix = known.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("sum"))
    smooth = lambda total, count: (total + PRIOR * rate) / (count + PRIOR)
    suffixes = cut(by_suffix.select("suffix", (F.col("n") / n).alias("suffix_share"), smooth(F.col("sum"), F.col("n")).alias("suffix_rate")))
    # a URL's own label is left out of the rate it is trained with
    without = known.join(by_suffix, "suffix").withColumns({"suffix_share": F.col("n") / n, "suffix_rate": smooth(F.col("sum") - F.col("label"), F.col("n") - 1)})
    # written, as every tree reads it again
    ready = _assembler().transform(cut(without.select(*FEATURES, "label"))).select("features", "label")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False).fit(ready)
    return UrlModel(trees, suffixes, rate)


def unwanted_host(url: Column, words: Sequence[str] = UNWANTED) -> Column:
    """1 where a part of the host between dots, hyphens or digits is one of the words, else 0."""
    return F.arrays_overlap(F.split(host(url), "[-.0-9_]+"), F.array(*map(F.lit, words))).cast("int")


def judge(urls: DataFrame, model: UrlModel | None, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """urls with host, path, rule, verdict and block_score. Where no rule fits the model decides; without a model such URLs are allowed.

    A null URL has an empty host and path. A row for each row of urls; repeated rows are judged alike, an empty table gives none.
    Columns of urls with these names are replaced.
    """
    kept = urls.drop("host", "path", "rule", "verdict", "block_score")
    scored = model.score(kept, url) if model else kept.withColumn("block_score", F.lit(0.0))
    found = rule_for(F.col("host"), F.col("path"), rules)
    decided = F.coalesce(F.col("__rule.verdict"), F.when(F.col("block_score") >= BLOCK_FROM, "block").otherwise("allow"))
    return scored.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url))).withColumn("__rule", found).withColumn("rule", F.col("__rule.rule")).withColumn("verdict", decided).drop("__rule")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    model = train(urls.withColumn("label", unwanted_host(F.col("url"))))
    return judge(urls, model).select("page_id", "host", "path", "rule", "verdict", "block_score")
