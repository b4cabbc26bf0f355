"""Pages and rectangles for evidence that lacks them, by looking for its words on all pages of its document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.locate import locate
from lectern.operators.matching import few, occurrences
from lectern.sources.tables import stored

# Words and characters of needles and of their variants; lengths of quotes; how many are located, with how many rectangles.
FEW_WORDS, FEW_CHARS, SKIPPED, TAKEN = 4, 48, 4, 10
VARIANTS, VARIANT_WORDS, VARIANT_MINIMUM = (36, 24), 5, 8
QUOTE, QUOTE_MINIMUM, LOCATED, RECTS = 200, 12, 8, 6


def page_needle(text: Column) -> Column:
    """What a text is searched by: some of its longer words, not the first ones, as those may be cut off; of a few words the beginning."""
    def of(words):
        start = F.least(F.lit(SKIPPED), F.greatest(F.lit(0), F.size(words) - TAKEN))
        return F.when(F.size(words) < FEW_WORDS, F.left(F.array_join(words, " "), F.lit(FEW_CHARS))).otherwise(F.array_join(F.slice(words, start + 1, F.lit(TAKEN)), " "))

    plain = T.squeeze(F.regexp_replace(T.whole(text), r"[^A-Za-z0-9_\s\u00A0\uFEFF\p{Z}.,;:%-]", " "))
    return F.transform(F.array(F.filter(F.split(plain, " "), lambda w: F.length(w) > 2)), of)[0]


def variants(needle: Column) -> Column:
    """The lower-cased beginnings of a needle that stand for it, of VARIANT_MINIMUM characters up; none of a shorter needle."""
    low = F.lower(needle)
    every = F.array(*[F.left(low, F.lit(n)) for n in VARIANTS], F.array_join(F.slice(F.split(low, " "), 1, VARIANT_WORDS), " "))
    return F.when(F.length(needle) >= VARIANT_MINIMUM, F.filter(F.array_distinct(every), lambda v: F.length(v) >= VARIANT_MINIMUM))


def shortest(needle: Column) -> Column:
    """The shortest of a needle's variants: as all of them are beginnings of one text, it stands on every page that holds any."""
    def of(low):
        words, cut = F.substring_index(low, " ", VARIANT_WORDS), F.left(low, F.lit(min(VARIANTS)))
        return F.when(F.length(words).between(VARIANT_MINIMUM, min(VARIANTS)), words).otherwise(cut)

    return F.transform(F.array(needle), lambda n: F.when(F.length(n) >= VARIANT_MINIMUM, F.transform(F.array(F.lower(n)), of)[0]))[0]


def _source() -> Column:
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(filled("anchor_text"), filled("context_text"), filled("text"), F.lit(""))


def fill_pages(evidence: DataFrame, pages: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """evidence(doc_id, anchor_text, context_text, text, page_start, page_end) with unknown pages filled by search, ``page_index0`` and ``via``.

    A known page is never changed. ``via`` is known, search, search-miss, or no-pages where the document has none. A page is never guessed from where
    a section stands. Rows stay as many as they are. columns: those of evidence that the result has (all, if not given); others are neither written nor
    shuffled. pages(doc_id, page, text) are read several times.
    """
    c = F.col
    kept = [x for x in columns or evidence.columns if x not in ("page_start", "page_end", "page_index0", "via")]
    # a needle is found first where the shortest of its variants is
    asked = evidence.withColumn("__needle", F.when(c("page_start").isNull(), shortest(page_needle(_source())))).withColumn("__row", F.monotonically_increasing_id())
    asked = stored(asked.select(*dict.fromkeys([*kept, "doc_id", "page_start", "page_end"]), "__needle", "__row"))
    needles = asked.select("doc_id", "__row", c("__needle").alias("needle"))
    found = occurrences(needles, pages.select("doc_id", "page", T.normalize_match(c("text")).alias("text")), "__row", True, True).groupBy("__row").agg(F.min("page").alias("__page"))
    # mostly none, or few
    without = asked.select("doc_id").distinct().join(pages.select("doc_id").distinct(), "doc_id", "left_anti").select(c("doc_id").alias("__without"))
    without = F.broadcast(without) if few(without) else without
    rows = asked.join(found, "__row", "left").join(without, c("doc_id") == c("__without"), "left")
    via = F.when(c("page_start").isNotNull(), "known").when(c("__page") > 0, "search").when(c("__without").isNotNull() | c("doc_id").isNull(), "no-pages").otherwise("search-miss")
    start, end = F.coalesce("page_start", F.when(c("__page") > 0, c("__page"))), F.when(c("page_start").isNull() & (c("__page") > 0), c("__page")).otherwise(c("page_end"))
    return rows.select(*kept, start.alias("page_start"), end.alias("page_end"), F.when(start >= 1, start - 1).alias("page_index0"), via.alias("via"))


def fill_rects(evidence: DataFrame, page_rows: DataFrame, most: int = LOCATED, rects: int = RECTS) -> DataFrame:
    """fill_pages' rows, with (query_id, rank, evidence_id), and ``rects`` located on locate.pages(): of each query's evidence in order of rank the first ``most`` that can be located.

    Evidence that has rects keeps them and counts. Located evidence gets the page it was found on as page_index0, and as page_start where that is
    unknown. evidence_id is unique within a document.
    """
    c = F.col
    rows = evidence if "rects" in evidence.columns else evidence.withColumn("rects", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    quotes = rows.filter(F.coalesce(F.size("rects"), F.lit(0)) <= 0).select(c("evidence_id").alias("quote_id"), "doc_id", T.cite_preview(_source(), QUOTE).alias("quote"), c("page_start").alias("hint"))
    found = locate(quotes.filter(F.length("quote") >= QUOTE_MINIMUM), page_rows)
    found = found.select(c("quote_id").alias("evidence_id"), "doc_id", c("page").alias("__page"), F.slice("rects", 1, rects).alias("__rects"))
    joined = rows.join(found, ["doc_id", "evidence_id"], "left")
    placed = (F.coalesce(F.size("rects"), F.lit(0)) > 0) | (F.size("__rects") > 0)
    order = W.partitionBy("query_id").orderBy("rank", "evidence_id").rowsBetween(W.unboundedPreceding, 0)
    counted = joined.withColumn("__placed", F.coalesce(placed, F.lit(False))).withColumn("__n", F.sum(c("__placed").cast("int")).over(order))
    new = c("__placed") & (c("__n") <= most) & (F.coalesce(F.size("rects"), F.lit(0)) <= 0)
    page = F.when(new, c("__page"))
    return counted.withColumns({
        "rects": F.when(new, c("__rects")).otherwise(c("rects")), "page_index0": F.coalesce(page - 1, "page_index0"),
        "page_end": F.when(new & c("page_start").isNull(), page).otherwise(c("page_end")), "page_start": F.coalesce("page_start", page),
    }).select(*rows.columns)


def soft_page(section: Column, n_pages: Column) -> Column:
    """A page for sections that stand at a known end: an abstract on the first, references on the last; null for all others, and without pages."""
    low = F.lower(T.whole(section))
    return F.when(n_pages < 1, None).when(F.contains(low, F.lit("abstract")), 1).when(F.contains(low, F.lit("reference")), n_pages)
