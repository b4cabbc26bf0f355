"""Documents to sections, parent chunks and child chunks, with locators.

A heading line opens a section; paragraphs are packed greedily into parents of at most PARENT_TOKENS; a
paragraph that is small enough is one child, else its sentences are packed into children of at most
CHILD_TOKENS. Lines, packs and children are ordered by explicit numbers; all state that depends
on the order is inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

PARENT_TOKENS, CHILD_TOKENS = 2000, 280
POLICY = "section-para-sent-v5"
BODY = "Body"
#: A first block of so many characters may hold an abstract of so many.
RECOVER_FROM, ABSTRACT_LOW, ABSTRACT_HIGH = 200, 100, 2500
#: Fixed value: an abstract without a heading of its own kind, up to the introduction or a numbered line.
ABSTRACT = rf"(?i)(?:^|\n)(?:Abstract[\s\S]{{0,40}}?\n)(?:[\s\S]{{{ABSTRACT_LOW},{ABSTRACT_HIGH}}}?)(?=\n(?:1\.?\s+)?Introduction{T.WORD_END}|\n[0-9]+\s+)"

PACK = "array<struct<low:int,high:int>>"


def pack(sizes: Column, limit: int) -> Column:
    """Greedy packing of consecutive sizes (array<long>) into array<struct<low, high>>, numbered from 0, both ends inclusive.

    A pack is closed before a piece that would take it over the limit; a piece that reaches the limit by itself
    stands alone.
    """
    none = F.expr(f"cast(array() as {PACK})")
    start = F.struct(none.alias("done"), F.lit(0).alias("low"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("total"))
    closed = lambda s: F.concat(s["done"], F.array(F.struct(s["low"].alias("low"), (s["at"] - 1).cast("int").alias("high"))))

    def step(s, size):
        is_open = s["low"] < s["at"]
        over = is_open & (s["total"] + size > limit)
        done = F.when(over, closed(s)).otherwise(s["done"])
        low = F.when(over | ~is_open, s["at"]).otherwise(s["low"])
        total = F.when(over | ~is_open, size).otherwise(s["total"] + size)
        alone = (total >= limit) & (low == s["at"])
        return F.struct(
            F.when(alone, F.concat(done, F.array(F.struct(s["at"].alias("low"), s["at"].alias("high"))))).otherwise(done).alias("done"),
            F.when(alone, s["at"] + 1).otherwise(low).cast("int").alias("low"),
            (s["at"] + 1).cast("int").alias("at"),
            F.when(alone, F.lit(0).cast("long")).otherwise(total).alias("total"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.when(s["low"] < s["at"], closed(s)).otherwise(s["done"]))


def document_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, line_no, line) from docs(doc_id, text) or docs(doc_id, pages array<struct<page, text>>): pages are read in their order."""
    if "pages" in docs.columns:
        rows = docs.select("doc_id", F.explode_outer(F.array_sort("pages")).alias("p")).select("doc_id", F.col("p.page").alias("page"), F.posexplode(T.lines(F.col("p.text"))).alias("n", "line"))
        order = W.partitionBy("doc_id").orderBy("page", "n")
        return rows.select("doc_id", "page", (F.row_number().over(order) - 1).alias("line_no"), "line")
    return docs.select("doc_id", F.lit(None).cast("int").alias("page"), F.posexplode(T.lines(T.normalize_block(F.col(text)))).alias("line_no", "line"))


def sections(rows: DataFrame) -> DataFrame:
    """(doc_id, sec, name, text, page_start, page_end) from document_lines: lines after a heading, which itself is in no text.

    Sections without text go; a document where none is left keeps all its lines as one Body.
    """
    headed = rows.withColumn("heading", T.is_heading(F.col("line")))
    order = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    numbered = headed.withColumn("sec", F.sum(F.col("heading").cast("int")).over(order))
    # lines are brought together by document and section, so a long document is no single row before its end
    grouped = numbered.groupBy("doc_id", "sec").agg(
        F.max(F.when(F.col("heading"), T.squeeze(F.col("line")))).alias("name"),
        F.sort_array(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "line")))).alias("ls"),
        F.min(F.when(~F.col("heading"), F.col("page"))).alias("page_start"),
        F.max(F.when(~F.col("heading"), F.col("page"))).alias("page_end"),
    )
    found = grouped.select("doc_id", "sec", F.coalesce("name", F.lit(BODY)).alias("name"), T.trim(F.array_join("ls.line", "\n")).alias("text"), "page_start", "page_end")
    kept = found.filter(F.col("text") != "")
    empty = found.groupBy("doc_id").agg(F.max((F.col("text") != "").cast("int")).alias("any")).filter("any = 0").select("doc_id")
    body = headed.join(empty, "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    body = body.select("doc_id", F.lit(0).cast("long").alias("sec"), F.lit(BODY).alias("name"), T.trim(F.array_join("ls.line", "\n")).alias("text"), "page_start", "page_end")
    return kept.unionByName(body)


def text_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """sections() of docs(doc_id, text) without pages: array work on the document's own row, nothing is shuffled.

    Where no section is named so, an abstract found in the first one's text is put before it.
    """
    let = lambda value, body: F.transform(F.array(value), body)[0]
    row = lambda sec, name, body: F.struct(sec.cast("long").alias("sec"), name.alias("name"), body.alias("text"))

    def cut(ls, heads):
        """The lines after each heading, and those before the first one."""
        starts = F.concat(F.array(F.lit(-1)), heads)
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(ls))
        body = lambda at, j: T.trim(F.array_join(F.slice(ls, at + 2, end(j) - at - 1), "\n"))
        every = F.transform(starts, lambda at, j: row(j, F.when(at < 0, BODY).otherwise(T.squeeze(F.get(ls, at))), body(at, j)))
        return let(F.filter(every, lambda x: x["text"] != ""), lambda kept: F.when(F.size(kept) > 0, recovered(kept)).otherwise(F.array(row(F.lit(0), F.lit(BODY), T.trim(F.array_join(ls, "\n"))))))

    def recovered(kept):
        first = kept[0]["text"]
        found = T.trim(F.regexp_extract(first, ABSTRACT, 0))
        lost = ~F.exists(kept, lambda x: x["name"].rlike("(?i)abstract")) & (F.length(first) > RECOVER_FROM) & (found != "")
        return F.when(lost, F.concat(F.array(row(F.lit(-1), F.lit("Abstract"), found)), kept)).otherwise(kept)

    heads = lambda ls: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: T.is_heading(F.get(ls, i)))
    secs = let(T.lines(T.normalize_block(F.col(text))), lambda ls: let(heads(ls), lambda found: cut(ls, found)))
    none = F.lit(None).cast("int")
    return docs.select("doc_id", F.explode_outer(secs).alias("s")).filter("s is not null").select("doc_id", "s.sec", "s.name", "s.text", none.alias("page_start"), none.alias("page_end"))


def chunk(found: DataFrame, parent_tokens: int = PARENT_TOKENS, child_tokens: int = CHILD_TOKENS) -> DataFrame:
    """The chunks of sections: (doc_id, seq, id, parent_id, kind, section, text, pages, paragraphs, sentences, anchor_text, token_estimate).

    A parent comes before its children; seq numbers them in that order from 1. Everything below a section is
    array work on the section's own row, so one shuffle by document, for the numbers, is all there is.
    """
    # outer, and filtered afterwards: of others Spark makes a filter that finds the exploded array a second time
    paras = found.withColumn("paras", T.paragraphs(F.col("text")))
    packs = paras.withColumn("packs", pack(F.transform("paras", T.estimate_tokens), parent_tokens)).withColumn("n_packs", F.size("packs"))
    parents = packs.select("*", F.posexplode_outer("packs").alias("pack", "p")).filter("p is not null").drop("packs", "text")
    parents = parents.withColumn("inside", F.slice("paras", F.col("p.low") + 1, F.col("p.high") - F.col("p.low") + 1)).drop("paras")

    def children(para, i):
        """The children of a paragraph; its sentences are split once."""
        def of(sents):
            whole = F.array(F.struct(F.lit(0).alias("low"), (F.size(sents) - 1).alias("high")))
            small = T.estimate_tokens(para) <= child_tokens
            spans = F.when(F.size(sents) == 0, F.expr(f"cast(array() as {PACK})")).when(small, whole).otherwise(pack(F.transform(sents, T.estimate_tokens), child_tokens))
            body = lambda s: F.when(small, para).otherwise(F.array_join(F.slice(sents, s["low"] + 1, s["high"] - s["low"] + 1), " "))
            return F.transform(spans, lambda s: F.struct(i.alias("para"), s["low"].alias("low"), s["high"].alias("high"), body(s).alias("text")))

        return F.flatten(F.transform(F.array(T.sentences(para)), of))

    low = F.col("p.low")
    parent_text = F.trim(F.array_join("inside", "\n\n"))
    section = F.when(F.col("n_packs") > 1, F.concat("name", F.lit(" ("), F.col("pack") + 1, F.lit(")"))).otherwise(F.col("name"))
    is_abstract = F.col("name").rlike("(?i)abstract")
    null_int = F.lit(None).cast("int")
    parent = F.struct(
        F.lit(-1).alias("i"), F.when(is_abstract, "abstract").otherwise("parent").alias("kind"), section.alias("section"), parent_text.alias("text"),
        (low + 1).alias("para_start"), (F.col("p.high") + 1).alias("para_end"), null_int.alias("sent_start"), null_int.alias("sent_end"),
    )
    child = F.transform(F.flatten(F.transform("inside", children)), lambda c, i: F.struct(
        i.alias("i"), F.when(is_abstract, "abstract").otherwise("child").alias("kind"), F.col("name").alias("section"), c["text"].alias("text"),
        (low + c["para"] + 1).alias("para_start"), (low + c["para"] + 1).alias("para_end"), (c["low"] + 1).cast("int").alias("sent_start"), (c["high"] + 1).cast("int").alias("sent_end"),
    ))
    rows = parents.select("doc_id", "sec", "pack", "page_start", "page_end", F.explode_outer(F.concat(F.array(parent), child)).alias("c")).select("doc_id", "sec", "pack", "page_start", "page_end", "c.*")
    order = W.partitionBy("doc_id").orderBy("sec", "pack", "i")
    numbered = rows.withColumn("seq", F.row_number().over(order))
    parent_seq = F.max(F.when(F.col("i") == -1, F.col("seq"))).over(W.partitionBy("doc_id", "sec", "pack"))
    named = lambda n: F.concat(F.col("doc_id").cast("string"), F.lit("-"), n.cast("string"))
    return numbered.withColumn("parent_seq", parent_seq).select(
        "doc_id", "seq", named(F.col("seq")).alias("id"), F.when(F.col("i") >= 0, named(F.col("parent_seq"))).alias("parent_id"), "kind", "section", "text", "page_start", "page_end",
        "para_start", "para_end", "sent_start", "sent_end", T.anchor(F.col("text")).alias("anchor_text"), T.estimate_tokens(F.col("text")).alias("token_estimate"),
    )


def chunk_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of docs(doc_id, text), or of docs(doc_id, pages). Documents without text have no chunks."""
    return chunk(sections(document_lines(docs, text)) if "pages" in docs.columns else text_sections(docs, text))


def parents_of(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.col("kind") == "parent") | ((F.col("kind") == "abstract") & F.col("parent_id").isNull()))


def units_of(chunks: DataFrame) -> DataFrame:
    """What is searched: children and abstracts."""
    return chunks.filter(F.col("kind").isin("child", "abstract"))
