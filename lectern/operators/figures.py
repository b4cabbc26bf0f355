"""Figures and tables: captions, and the paragraphs that discuss them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T

# How captions and mentions of figures and tables look.
NAMES = "Figure|Fig|FIGURE|Table|TABLE|표|그림"
CAPTION = rf"(?m)^[ \t]*((?:{NAMES})\.?\s*[0-9A-Za-z.]+)\s*[.:\-]?\s*([^\n]{{0,320}})"
MENTION = rf"(?:{NAMES})\.?\s*[0-9]+"
CUES = "(?i)show|depict|illustrat|compare|result|ablation|see fig|as shown"
# The parts of a bundle, and how much of each it has.
HEAD, CAPTIONS, DISCUSSION, NOTHING = "=== Figure / table captions & paper discussion (deterministic extract) ===", "Captions:", "In-text discussion:", "(No explicit Figure/Table captions found in extract.)"
FOCUS, BOOST = "Page focus: p.", "figure caption table chart diagram plot axis legend"
BUNDLE_MENTIONS, BUNDLE_PARAGRAPHS, BUNDLE_LABELS, BUNDLE_CAPTIONS, QUERY_CAPTIONS, QUERY_PARAGRAPH = 16, 8, 12, 10, 400, 200
CAPTION_LIMIT, MENTIONS, PARAGRAPH_MINIMUM, PARAGRAPH_LIMIT, DISCUSSIONS = 360, 24, 40, 900, 10


def mentions(text: Column, limit: int = MENTIONS) -> Column:
    """array<struct<label, caption>>: captions in their order, the first of each label."""
    hits = F.regexp_extract_all(T.whole(text), F.lit(CAPTION), F.lit(0))
    pair = lambda h: F.struct(T.squeeze(F.regexp_extract(h, CAPTION, 1)).alias("label"), F.left(T.squeeze(F.concat_ws(" ", F.regexp_extract(h, CAPTION, 1), F.regexp_extract(h, CAPTION, 2))), F.lit(CAPTION_LIMIT)).alias("caption"))
    found = F.transform(hits, pair)
    first = lambda f: F.filter(f, lambda m, i: F.array_position(F.transform(f, lambda x: F.lower(x["label"])), F.lower(m["label"])) == i + 1)
    return F.slice(F.transform(F.array(found), first)[0], 1, limit)


def discussions(text: Column, labels: Column, limit: int = DISCUSSIONS) -> Column:
    """array<string>: paragraphs that mention a figure or table, those of the labels and with cues first, lists of references last or never."""
    paras = F.filter(F.transform(F.split(T.whole(text), "\n{2,}"), T.squeeze), lambda p: (F.length(p) > PARAGRAPH_MINIMUM) & p.rlike(MENTION))

    def score(p):
        named = F.size(F.filter(labels, lambda x: (x != "") & F.contains(F.lower(p), F.lower(x))))
        listed = p.rlike(r"^\[[0-9]+\]") | (F.regexp_count(p, F.lit(r"\[[0-9]+\]")) > 4)
        return 1 + 3 * named + p.rlike(CUES).cast("int") - F.when(listed, 2).otherwise(0)

    scored = F.transform(paras, lambda p, i: F.struct((-score(p)).alias("first"), i.alias("i"), F.left(p, F.lit(PARAGRAPH_LIMIT)).alias("p")))
    ranked = F.transform(F.array_sort(F.filter(scored, lambda s: s["first"] < 0)), lambda s: s["p"])
    once = lambda r: F.filter(r, lambda p, i: F.array_position(F.transform(r, lambda x: F.left(x, F.lit(80))), F.left(p, F.lit(80))) == i + 1)
    return F.slice(F.transform(F.array(ranked), once)[0], 1, limit)


def bundle(text: Column, question: Column, page_label: Column, prefer: Column) -> Column:
    """struct(mentions, paragraphs, labels, query, block): what a question about a text's figures and tables is answered from.

    prefer: array of labels, whose paragraphs come first; null or empty stands for those of the captions. query is what is searched for beside the block:
    question, captions and the first paragraph. Null and empty texts give empty arrays and a block that says so.
    """
    let = lambda value, body: F.transform(F.array(value), body)[0]
    filled = lambda c: F.nullif(T.whole(c), F.lit(""))

    def of(m):
        own = F.transform(m, lambda x: x["label"])
        asked = F.filter(F.coalesce(prefer, F.array().cast("array<string>")), lambda x: T.whole(x) != "")
        first = F.when(F.size(asked) > 0, asked).otherwise(own)
        labels = F.slice(F.array_distinct(F.concat(first, own)), 1, BUNDLE_LABELS)
        captions = F.array_join(F.transform(F.slice(m, 1, BUNDLE_CAPTIONS), lambda x: x["caption"]), "\n")

        def with_paragraphs(ps):
            body = F.array_join(ps, "\n\n")
            none = F.when((captions == "") & (body == ""), NOTHING)
            part = lambda name, c: F.when(c != "", F.concat(F.lit(name + "\n"), c))
            block = F.concat_ws("\n", F.lit(HEAD), F.concat(F.lit(FOCUS), filled(page_label)), part(CAPTIONS, captions), part(DISCUSSION, body), none)
            query = F.concat_ws(
                "\n", filled(question), F.lit(BOOST), F.nullif(F.array_join(labels, " "), F.lit("")), F.nullif(F.left(captions, F.lit(QUERY_CAPTIONS)), F.lit("")),
                F.nullif(F.left(F.get(ps, F.lit(0)), F.lit(QUERY_PARAGRAPH)), F.lit("")), F.concat(F.lit("page "), filled(page_label)),
            )
            return F.struct(m.alias("mentions"), ps.alias("paragraphs"), labels.alias("labels"), query.alias("query"), block.alias("block"))

        return let(discussions(text, first, BUNDLE_PARAGRAPHS), with_paragraphs)

    return let(mentions(text, BUNDLE_MENTIONS), of)
