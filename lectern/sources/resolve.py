"""Where a document's text comes from: the items it may stand in, and the first of several sources that has any, with the trail of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

# Sources by rank, ways of the full text by rank, and the characters that a text must be longer than.
SOURCES, WAYS, LEAST = ("reader", "fulltext", "reindex"), ("ft-cache", "getItemContent", "getIndexedContent", "getItemUnprocessedContent"), 40


def candidate_items(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, place, item_id) from asked(doc_id, item_id) and items(item_id, parent_id, content_type): where a document's text may be, each once, place from 1.

    An attachment: itself, then its parent. Another item: its attachments that are PDF, the last one first, then itself, then its other attachments by
    number. An item that isn't among items stands alone.
    """
    c = F.col
    known = asked.filter("item_id > 0").join(items.select("item_id", "parent_id"), "item_id", "left")
    own = known.select("doc_id", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("n"), "item_id")
    parents = known.filter("parent_id is not null").select("doc_id", F.lit(2).alias("tier"), F.lit(0).cast("long").alias("n"), c("parent_id").alias("item_id"))
    pdf = F.coalesce(c("content_type").rlike("(?i)pdf"), F.lit(False))
    parts = items.filter("parent_id is not null").select(c("parent_id").alias("item_id"), c("item_id").alias("part"), pdf.alias("pdf"))
    attached = known.filter("parent_id is null").join(parts, "item_id").select("doc_id", F.when(c("pdf"), 0).otherwise(2).alias("tier"), F.when(c("pdf"), -c("part")).otherwise(c("part")).alias("n"), c("part").alias("item_id"))
    once = own.union(parents).union(attached).groupBy("doc_id", "item_id").agg(F.min(F.struct("tier", "n")).alias("at"))
    listed = once.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "item_id"))).alias("xs"))
    return listed.select("doc_id", F.posexplode("xs.item_id").alias("place", "item_id")).withColumn("place", c("place") + 1)


def resolve_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, source, attempts) of docs(doc_id) from found(doc_id, source, place, item_id, how, text): for every document the first text longer than LEAST characters.

    Sources come in the order of SOURCES, within one the items by place, within an item the ways in the order of WAYS. ``attempts`` has what was tried in that
    order, up to and with the one that was taken, as source:item:how:length. A document without a text that is long enough has all its attempts, an
    empty text and the source ``empty``; it is named, not lost. Other sources and repeated rows don't matter.
    """
    c = F.col
    rank = lambda names, x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c(x)), F.lit(0)), F.lit(len(names) + 1))
    body = T.trim(T.whole(c("text")))
    tried = found.filter(c("source").isin(*SOURCES)).select(
        "doc_id", rank(SOURCES, "source").alias("a"), F.coalesce("place", F.lit(0)).alias("b"), rank(WAYS, "how").alias("c"), "source",
        F.concat_ws(":", "source", c("item_id").cast("string"), "how", F.length(body).cast("string")).alias("said"), body.alias("text"), (F.length(body) > LEAST).alias("enough"),
    ).distinct()
    # the text of the first that is enough travels alone, attempts without theirs
    at = F.struct("a", "b", "c", "said")
    best = tried.filter("enough").groupBy("doc_id").agg(F.min(at).alias("won"), F.min_by(F.struct("text", "source"), at).alias("x"))
    trail = tried.groupBy("doc_id").agg(F.array_sort(F.collect_set(at)).alias("all"))
    rows = docs.select("doc_id").join(trail, "doc_id", "left").join(best, "doc_id", "left")
    upto = F.when(c("won").isNull(), c("all")).otherwise(F.filter("all", lambda x: x <= c("won")))
    said = F.coalesce(F.transform(upto, lambda x: x["said"]), F.expr("cast(array() as array<string>)"))
    return rows.select("doc_id", F.coalesce("x.text", F.lit("")).alias("text"), F.coalesce("x.source", F.lit("empty")).alias("source"), said.alias("attempts"))
