"""Highlights: passages worth marking, quotes that are really there, and caps on both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.locate import locate

# Sections by weight (the greatest that fits counts, and 1 at least, so those below 1 change nothing); lengths in tokens by factor; limits.
SECTION_WEIGHTS = (
    ("abstract", 3.0), ("introduction", 2.5), ("conclusion", 2.5), ("contribution|novel", 2.2), ("method|approach|experiment", 2.0), ("result|finding", 2.0), ("limitation|discussion", 1.8),
    ("related", 0.6), ("reference", 0.2),
)
LENGTH_FACTORS = ((40, 0.5), (120, 1.2), (280, 1.0))
LONG_FACTOR = 0.7
MAX_PASSAGES, TOKEN_BUDGET, PASSAGE_MINIMUM, PASSAGE_KEY = 28, 6000, 40, 80
CATEGORIES = ("claim", "method", "novelty", "caveat")
QUOTE_MINIMUM, PER_CATEGORY, IN_ALL = 24, 4, 16


def section_weight(section: Column) -> Column:
    low = F.lower(section)
    return F.greatest(F.lit(1.0), *[F.when(low.rlike(p), w).otherwise(1.0) for p, w in SECTION_WEIGHTS])


def passage_score(section: Column, tokens: Column) -> Column:
    factor = F.lit(LONG_FACTOR)
    for below, f in reversed(LENGTH_FACTORS):
        factor = F.when(tokens < below, f).otherwise(factor)
    return section_weight(section) * factor


def select_passages(units: DataFrame, by: str = "doc_id", budget: int = TOKEN_BUDGET, most: int = MAX_PASSAGES) -> DataFrame:
    """(by, rank, seq, section, text, token_estimate): units by score while they fit the budget; what doesn't fit or begins like one taken is passed over."""
    rows = units.filter(F.length("text") >= PASSAGE_MINIMUM).withColumn("score", passage_score(F.col("section"), F.col("token_estimate")))
    ordered = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("first"), "seq", "section", "text", "token_estimate"))).alias("us"))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("taken"), F.expr("cast(array() as array<string>)").alias("keys"), F.lit(0).cast("long").alias("used"))

    def step(s, i):
        u = F.col("us")[i]
        key = F.left(F.lower(u["text"]), F.lit(PASSAGE_KEY))
        fits = (F.size(s["taken"]) < most) & (s["used"] + u["token_estimate"] <= budget) & ~F.array_contains(s["keys"], key)
        return F.struct(
            F.when(fits, F.concat(s["taken"], F.array(i))).otherwise(s["taken"]).alias("taken"), F.when(fits, F.concat(s["keys"], F.array(key))).otherwise(s["keys"]).alias("keys"),
            F.when(fits, s["used"] + u["token_estimate"]).otherwise(s["used"]).alias("used"),
        )

    taken = ordered.withColumn("taken", F.aggregate(F.sequence(F.lit(0), F.size("us") - 1), start, step, lambda s: s["taken"]))
    return taken.select(by, "us", F.posexplode("taken").alias("n", "i")).select(by, (F.col("n") + 1).alias("rank"), F.col("us")[F.col("i")].alias("u")).select(by, "rank", "u.seq", "u.section", "u.text", "u.token_estimate")


ITEMS = "struct<items:array<struct<category:string,quote:string,reason:string>>>"


def parse_items(raw: Column) -> Column:
    """The items of a model's JSON answer: as it stands, from a fenced block, or between the outermost braces; null if none parses."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    read = lambda c: F.from_json(F.when(F.trim(c).startswith("{"), c), ITEMS)["items"]
    return F.coalesce(read(raw), read(fenced), read(braces))


def cap_items(items: DataFrame, by: list[str], order: str, per_category: int = PER_CATEGORY, in_all: int = IN_ALL) -> DataFrame:
    """Items of known categories in their order: so many of a category, so many in all; sorted by category."""
    known = items.filter(F.col("category").isin(*CATEGORIES))
    few = known.withColumn("__n", F.row_number().over(W.partitionBy(*by, "category").orderBy(order))).filter(F.col("__n") <= per_category)
    few = few.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter(F.col("__n") <= in_all).drop("__n")
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return few.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(place, order)))


#: Characters that are hashed for the keys of quotes without inner tokens, and the odd multiplier.
GRAM, TIMES = 8, 0x9E3779B97F4A7C15


def _window_keys(text: str, width: int) -> np.ndarray:
    """For each run of width characters, in order, the least hash of its GRAM characters on end: equal runs have equal keys."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, gram = len(codes) - width + 1, min(GRAM, width)
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(len(codes) - gram + 1, np.uint64)
    for i in range(gram):
        h = (h + codes[i : i + len(h)] + np.uint64(1)) * np.uint64(TIMES)
        h ^= h >> np.uint64(29)
    low = h[:n]
    for i in range(1, width - gram + 1):
        low = np.minimum(low, h[i : i + n])
    return low.view(np.int64)


def _keys(text: Column, width: int, first: bool) -> Column:
    """The distinct keys of a text's runs of width characters, or that of the first one alone."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else _window_keys(t[:width], width) if first else np.unique(_window_keys(t, width)) for t in texts], dtype=object)

    return of(text)


def verify_quotes(quotes: DataFrame, texts: DataFrame, minimum: int = QUOTE_MINIMUM) -> DataFrame:
    """(quote_id, text_id): the texts(text_id, text) that hold a quote(quote_id, quote), both lower-cased with white space squeezed.

    Quote and text first meet by the longest of the quote's inner tokens, which any text that holds the quote has as a
    token, then the quote is looked for; so texts are not paired with all quotes. Quotes without inner tokens (of other
    scripts, or of one or two long words) meet texts by the key of their first minimum characters instead. Quotes shorter than the
    minimum are not verified.
    """
    wanted = quotes.withColumn("needle", T.normalize_match(F.col("quote"))).filter(F.length("needle") >= minimum).withColumn("toks", T.tokens(F.col("needle")))
    inner = F.when(F.size("toks") > 2, F.slice("toks", 2, F.size("toks") - 2))
    every = wanted.withColumn("key", F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]).select("quote_id", "needle", "key")
    keyed, bare = every.filter("key is not null"), every.filter("key is null")
    have = texts.select("text_id", T.normalize_match(F.col("text")).alias("hay"))
    # keys travel without the texts; a text is joined to the quotes that share a key with it
    slim = have.select("text_id", F.explode(F.array_distinct(T.tokens(F.col("hay")))).alias("key")).join(keyed.select("key").distinct(), "key", "left_semi")
    near = slim.join(keyed, "key").select(F.col("text_id").alias("near_id"), "quote_id", "needle")
    width = max(1, minimum)
    bare = bare.select("quote_id", "needle", F.explode(_keys(F.col("needle"), width, True)).alias("run"))
    runs = have.select("text_id", F.explode(_keys(F.col("hay"), width, False)).alias("run")).join(bare.select("run").distinct(), "run", "left_semi").distinct()
    near = near.union(runs.join(bare, "run").select(F.col("text_id").alias("near_id"), "quote_id", "needle")).distinct()
    return have.join(near, F.col("text_id").eqNullSafe(F.col("near_id"))).filter(F.contains("hay", "needle")).select("quote_id", "text_id")


def ground_items(items: DataFrame, selected: DataFrame, by: str = "doc_id", per_category: int = PER_CATEGORY, in_all: int = IN_ALL) -> DataFrame:
    """(by, n, category, quote, reason, candidate, place): the items(by, n, category, quote, reason) whose quote stands in a candidate(by, rank, text), with the first that has it.

    Quotes and candidates are compared lower-cased with white space squeezed; quotes shorter than QUOTE_MINIMUM, and items of other categories, go. In order of n so
    many of a category are kept and so many in all; place is by category, then n. Items and candidates without ``by`` don't meet. Candidates are few and short, as
    select_passages() gives them: those of a document travel as one row, and each of its items is looked for in them.
    """
    c = F.col
    asked = items.filter(c("category").isin(*CATEGORIES)).withColumn("__needle", T.normalize_match(c("quote"))).filter(F.length("__needle") >= QUOTE_MINIMUM)
    passage = F.struct(c("rank").isNull().alias("last"), "rank", T.normalize_match(c("text")).alias("text"))
    texts = selected.groupBy(by).agg(F.sort_array(F.collect_list(passage)).alias("__texts"))
    # exploded, so that candidates are searched once: of a filter on them the join makes a condition that searches them again
    hit = F.explode_outer(F.slice(F.filter("__texts", lambda t: F.contains(t["text"], c("__needle"))), 1, 1))
    found = asked.join(texts, by).withColumn("__hit", hit).filter("__hit is not null").withColumn("candidate", c("__hit.rank")).drop("__texts", "__needle", "__hit")
    return cap_items(found, [by], "n", per_category, in_all).select(by, "n", "category", "quote", "reason", "candidate", "place")


def candidates(selected: DataFrame, units: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, rank, id, section, text, page_start, para_start, sent_start): selected passages as a model is asked about them, texts trimmed."""
    places = units.select(by, "seq", "id", "page_start", "para_start", "sent_start")
    return selected.join(places, [by, "seq"]).select(by, "rank", "id", "section", T.trim(F.col("text")).alias("text"), "page_start", "para_start", "sent_start")


# How each category is drawn, its colour and label; limits of an annotation's texts.
CLASSES = {"claim": ("highlight", "#ffd400", "주장·결과"), "method": ("underline", "#2ea8e5", "방법·정의"), "novelty": ("highlight", "#5fb236", "기여·새로움"), "caveat": ("underline", "#ff6666", "한계·가정")}
ANNOTATION_TEXT, ANNOTATION_COMMENT = 2000, 4000


def annotate(items: DataFrame, page_rows: DataFrame, author: str = "lectern", root: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(applied, skipped): annotations of items(item_id, doc_id, category, quote, reason, page_start) on locate.pages(), and the items without one.

    Pages count from 1, page_index from 0. Items are told apart by document and id. Items whose quote is on no page, or whose category is none of CLASSES, are
    skipped. author and root are the names that comments and tags begin with.
    """
    known = items.filter(F.col("category").isin(*CLASSES))
    quotes = known.select(F.col("item_id").alias("quote_id"), "doc_id", "quote", F.col("page_start").alias("hint"))
    found = locate(quotes, page_rows).select(F.col("quote_id").alias("item_id"), "doc_id", "page", "rects")
    drawn = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (k, v[i])]), F.col("category"))
    comment = F.concat(F.lit(f"[{author} · auto · "), F.col("category"), F.lit("] "), drawn(2), F.lit("\n"), F.coalesce("reason", F.lit("")))
    index = F.col("page") - 1
    applied = known.join(found, ["doc_id", "item_id"]).select(
        "item_id", "doc_id", "category", drawn(0).alias("type"), drawn(1).alias("color"), F.left("quote", F.lit(ANNOTATION_TEXT)).alias("text"), F.left(comment, F.lit(ANNOTATION_COMMENT)).alias("comment"),
        F.col("page").cast("string").alias("page_label"), index.alias("page_index"), F.concat(F.lpad(index.cast("string"), 5, "0"), F.lit("|000000|00000")).alias("sort_index"), "rects",
        F.array(F.lit(root), F.concat(F.lit(f"{root}/"), F.col("category"))).alias("tags"),
    )
    return applied, items.join(found, ["doc_id", "item_id"], "left_anti")


def is_automatic(tags: Column, root: str = "auto") -> Column:
    """Whether tags name an annotation that annotate() made under the root: the root itself or one below it. Null tags don't."""
    return F.coalesce(F.exists(tags, lambda t: F.coalesce((t == root) | t.startswith(f"{root}/"), F.lit(False))), F.lit(False))


def without_automatic(annotations: DataFrame, root: str = "auto") -> DataFrame:
    """annotations(tags) but for those that annotate() made under the same root."""
    return annotations.filter(~is_automatic(F.col("tags"), root))


def without_listed(annotations: DataFrame, keys: DataFrame, root: str = "auto") -> DataFrame:
    """annotations(doc_id, key, tags) but for the automatic ones among keys(doc_id, key); others with such a key stay."""
    gone = annotations.filter(is_automatic(F.col("tags"), root)).join(keys.select("doc_id", "key"), ["doc_id", "key"], "left_semi").select("doc_id", "key").distinct()
    return annotations.join(gone.withColumn("__gone", F.lit(True)), ["doc_id", "key"], "left").filter(F.col("__gone").isNull() | ~is_automatic(F.col("tags"), root)).select(*annotations.columns)


# Limits of listed texts, the category and the page of annotations that name none.
LISTED_QUOTE, LISTED_REASON, LISTED_CATEGORY, LISTED_PAGE = 400, 120, "claim", "?"


def list_automatic(annotations: DataFrame, author: str = "lectern", root: str = "auto") -> DataFrame:
    """(doc_id, key, category, quote, reason, page_label, color, type) of the automatic ones of annotations(doc_id, key, tags, text, comment, page_label).

    The category is that of the first tag which names one, exactly; the reason is the comment without its bracket. Null texts are empty.
    """
    drawn = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (k, v[i])]), F.col("category"))
    named = F.filter("tags", lambda t: t.isin(*[f"{root}/{k}" for k in CLASSES]))
    category = F.coalesce(F.substring(F.get(named, F.lit(0)), len(root) + 2, max(map(len, CLASSES))), F.lit(LISTED_CATEGORY))
    reason = F.regexp_replace(T.whole(F.col("comment")), rf"(?i)^\[\Q{author}\E[^\]]*\]\s*", "")
    rows = annotations.filter(is_automatic(F.col("tags"), root)).withColumn("category", category)
    label = F.coalesce(F.nullif("page_label", F.lit("")), F.lit(LISTED_PAGE))
    quote = F.left(T.whole(F.col("text")), F.lit(LISTED_QUOTE))
    return rows.select("doc_id", "key", "category", quote.alias("quote"), F.left(reason, F.lit(LISTED_REASON)).alias("reason"), label.alias("page_label"), drawn(1).alias("color"), drawn(0).alias("type"))


def annotation_place(label: Column, position: Column) -> Column:
    """struct(page_index, rects) from an annotation's position as JSON; without a page there, the page is the number that its label begins with, less one. Null where neither says."""
    read = F.from_json(position, "pageIndex int, rects array<array<double>>")
    number = F.regexp_extract(label, r"^\s*([0-9]+)", 1).try_cast("int")
    return F.struct(F.coalesce(read["pageIndex"], F.when(number > 0, number - 1)).alias("page_index"), read["rects"].alias("rects"))


def candidate_prompts(asked: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, n, prompt): a document's candidates() as one text, in order of rank: a head with number, id and place, then the passage. Missing or empty parts of a place are left out."""
    part = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    place = F.concat_ws(" ", F.nullif("section", F.lit("")), part("¶", "para_start"), part("s", "sent_start"), part("p.", "page_start"))
    # select_passages() gives MAX_PASSAGES rows a document at most
    rows = asked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), place, F.lit("\n"), T.whole(F.col("text"))).alias("t")))).alias("cs"))
    lines = F.transform("cs", lambda c, i: F.concat(F.lit("### C"), (i + 1).cast("string"), F.lit(" "), c["t"]))
    return rows.select(by, F.size("cs").cast("long").alias("n"), F.array_join(lines, "\n\n").alias("prompt"))
