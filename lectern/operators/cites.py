"""Citations: the links of an answer's evidence, the labels that lead to them, and labels in a text made into links.

Rewriting works by an edit script: everything that is to change is found on the original text as intervals with a priority, overlaps are resolved
once, and the script is applied once. Nothing inside markup or a link changes, so a second run changes nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

# Lengths of previews, titles, phrases and excerpts; words of phrases; rectangles of a link; what stands for evidence without words.
PREVIEW, TITLE, VISIBLE, EXCERPT, EXCERPT_FROM = 320, 400, 120, 160, 120
PHRASE, TRAY_PHRASE, PHRASE_FROM, PHRASE_WORDS = 48, 40, 8, 6
BEFORE, TAIL, TAIL_LEAST, WORDS = 80, 48, 40, 8
RECTS, DIGITS, LEAST_PHRASE = 6, 2, 3
EVIDENCE, NO_EXCERPT, FOOTER = "근거", "(발췌 없음)", "근거 (문구 클릭 → PDF 해당 문장 · 호버 시 발췌):"

EVIDENCE_COLUMNS = ("section", "para_start", "para_end", "sent_start", "sent_end", "page_start", "page_end", "page_index0", "anchor_text", "context_text", "text")


def bare_section(section: Column) -> Column:
    """[§section]; null without one."""
    return F.when(T.whole(section) != "", F.concat(F.lit("["), _marked(section), F.lit("]")))


def _marked(section: Column) -> Column:
    return F.when(section.startswith("§"), section).otherwise(F.concat(F.lit("§"), section))


def encode_rects(rects: Column) -> Column:
    """The first rectangles, array<struct<x1, y1, x2, y2>>, as JSON, rounded; the empty string without any."""
    number = lambda x: F.regexp_replace(T.round_half_up(x, DIGITS).cast("decimal(20,2)").cast("string"), r"\.?0+\z", "")
    one = lambda r: F.concat(F.lit("["), F.array_join(F.transform(F.array(r["x1"], r["y1"], r["x2"], r["y2"]), number), ","), F.lit("]"))
    return F.when(F.coalesce(F.size(rects), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(F.transform(F.slice(rects, 1, RECTS), one), ","), F.lit("]"))).otherwise("")


def parse_rects(raw: Column) -> Column:
    """The rectangles of encode_rects' string: those of four numbers or more, the first four; null where there are none."""
    found = F.filter(F.from_json(raw, "array<array<double>>"), lambda r: (F.size(r) >= 4) & ~F.exists(r, lambda x: x.isNull()))
    named = F.transform(found, lambda r: F.struct(*[r[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))
    return F.when(F.size(named) > 0, named)


def href(page: Column, preview: Column) -> Column:
    """Where a link leads: to a page, to a search for its preview, or nowhere."""
    return F.when(page.isNotNull(), F.concat(F.lit("#page-"), page.cast("string"))).when(T.whole(preview) != "", "#search").otherwise("#cite")


def default_phrase(preview: Column, label: Column, meta: Column, most: int = PHRASE) -> Column:
    """What a link shows where its text has no phrase for it: the preview's first words, else the place, else its number."""
    words = F.slice(F.split(T.squeeze(preview), " "), 1, PHRASE_WORDS)
    first = F.array_join(words, " ")
    short = F.when(F.length(first) > most, F.concat(F.trim(F.left(first, F.lit(most - 1))), F.lit("…"))).otherwise(first)
    number = F.concat(F.lit(f"{EVIDENCE} "), F.regexp_replace(label, "^[Ee]", ""))
    return F.when(F.length(T.squeeze(preview)) >= PHRASE_FROM, short).otherwise(F.coalesce(F.nullif(F.get(F.split(meta, " · "), F.lit(0)), F.lit("")), number))


def cite_links(evidence: DataFrame) -> DataFrame:
    """(answer_id, n, cite, label, page_start, page_end, preview, rects, meta, aliases, phrase, opening) from evidence(answer_id, n, cite, rects, EVIDENCE_COLUMNS).

    An answer's evidence is read in the order of n, from 0. Evidence whose cite an earlier one has, as its own or as an alias, is no link; an alias leads to
    the first that has it. Evidence without a cite is [n + 1]. ``opening`` is the link's tag, ``phrase`` what it shows by default. The evidence of an answer is
    what retrieval returns for it, a bounded number of rows, and is brought together in one.
    """
    c = F.col
    place = [(c("para_start"), c("para_end")), (c("sent_start"), c("sent_end"))]
    key = F.coalesce(F.nullif(c("cite"), F.lit("")), F.concat(F.lit("["), (c("n") + 1).cast("string"), F.lit("]")))
    inside, suffix = _marked(c("section")), T.locator_suffix(*place)
    pages = F.when(c("page_start").isNull(), "").when(c("page_end").isNotNull() & (c("page_end") != c("page_start")), F.concat(F.lit(" p."), "page_start", F.lit("–"), "page_end")).otherwise(F.concat(F.lit(" p."), "page_start"))
    number = F.regexp_replace(key, "[^0-9]", "")
    named = F.when(T.whole(c("section")) != "", F.array(F.concat(F.lit("["), inside, suffix, pages, F.lit("]")), bare_section(c("section")), F.concat(F.lit("["), inside, suffix, F.lit("]"))))
    legacy = F.when(number.rlike("[1-9]"), F.array(F.concat(F.lit("[E"), F.regexp_replace(number, "^0+", ""), F.lit("]"))))
    none = F.expr("cast(array() as array<string>)")
    filled = lambda x: F.nullif(c(x), F.lit(""))
    meta = F.coalesce(T.locator(c("section"), *place, (c("page_start"), c("page_end"))), F.lit(""))
    rows = evidence.select(
        "answer_id", "n", key.alias("cite"), F.coalesce("page_start", c("page_index0") + 1).alias("page_start"), "page_end",
        T.cite_preview(F.coalesce(filled("anchor_text"), filled("context_text"), filled("text")), PREVIEW).alias("preview"), "rects", meta.alias("meta"),
        F.array_distinct(F.concat(F.coalesce(named, none), F.coalesce(legacy, none))).alias("aliases"),
    )
    gathered = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("n", "cite", "aliases", "page_start", "page_end", "preview", "rects", "meta"))).alias("es"))

    def step(s, i):
        e = F.get(c("es"), i)
        fresh = F.filter(e["aliases"], lambda a: (a != e["cite"]) & ~F.array_contains(s["seen"], a))
        # the aliases that are left go with the number of the evidence
        taken = F.struct(F.concat(s["seen"], F.array(e["cite"]), fresh).alias("seen"), F.concat(s["out"], F.array(F.struct(i.alias("i"), fresh.alias("aliases")))).alias("out"))
        return F.when(F.array_contains(s["seen"], e["cite"]), s).otherwise(taken)

    start = F.struct(none.alias("seen"), F.expr("cast(array() as array<struct<i:int,aliases:array<string>>>)").alias("out"))
    kept = gathered.withColumn("kept", F.aggregate(F.sequence(F.lit(0), F.size("es") - 1), start, step, lambda s: s["out"]))
    links = kept.select("answer_id", "es", F.explode("kept").alias("k")).select("answer_id", F.get(c("es"), c("k.i")).alias("e"), "k.aliases").select("answer_id", "e.n", "e.cite", "e.page_start", "e.page_end", "e.preview", "e.rects", "e.meta", "aliases")
    label = F.regexp_replace(F.regexp_replace("cite", r"^\[", ""), r"\]\z", "")
    links = links.withColumn("label", label).withColumn("phrase", default_phrase(c("preview"), c("label"), c("meta")))
    return links.withColumn("opening", _opening())


def _opening(classes: str = "cite cite-phrase") -> Column:
    c = F.col
    attribute = lambda name, value: F.when(T.whole(value) != "", F.concat(F.lit(f' {name}="'), T.escape_html(value), F.lit('"'))).otherwise("")
    page = F.when(c("page_start").isNotNull() & ~F.contains("meta", F.concat(F.lit("p."), c("page_start").cast("string"))), F.concat(F.lit("p."), c("page_start").cast("string")))
    title = F.left(F.concat_ws(" · ", F.nullif(c("meta"), F.lit("")), page, F.nullif(c("preview"), F.lit(""))), F.lit(TITLE))
    return F.concat(
        F.lit(f'<a class="{classes}" href="'), href(c("page_start"), c("preview")), F.lit('" title="'), T.escape_html(title), F.lit('"'), attribute("data-eid", F.regexp_replace("label", "^[Ee]", "")),
        attribute("data-page", c("page_start").cast("string")), attribute("data-preview", c("preview")), attribute("data-rects", encode_rects(c("rects"))), F.lit(">"),
    )


def cite_labels(links: DataFrame) -> DataFrame:
    """(answer_id, label, n): which link each label leads to. A link's own labels (its cite, and its number in any of the usual forms) go before aliases; of own ones the last link's counts, of aliases the first's."""
    c = F.col
    number = F.regexp_replace("label", "^[Ee]", "")
    plain = F.when(number.rlike(r"^[0-9]*[1-9][0-9]*\z"), F.regexp_replace(number, "^0+", ""))
    forms = F.filter(F.transform(F.array(*map(F.lit, ("{}", "[{}]", "[E{}]", "[e{}]", "E{}"))), lambda f: F.replace(f, F.lit("{}"), plain)), lambda x: x.isNotNull())
    own = F.concat(F.array("cite", "label", F.lower("cite")), forms)
    inner = lambda a: F.regexp_replace(F.regexp_replace(a, r"^\[", ""), r"\]\z", "")
    other = F.concat("aliases", F.transform("aliases", inner))
    tagged = F.concat(F.transform(own, lambda x: F.struct(x.alias("label"), F.lit(True).alias("own"))), F.transform(other, lambda x: F.struct(x.alias("label"), F.lit(False).alias("own"))))
    rows = links.select("answer_id", "n", F.explode(F.array_distinct(tagged)).alias("x")).select("answer_id", "n", "x.label", "x.own")
    return rows.groupBy("answer_id", "label").agg(F.coalesce(F.max(F.when(c("own"), c("n"))), F.min("n")).alias("n"))


def resolve(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """asked(answer_id, number) with ``n``, the link that the number leads to: as [1], as [E1], or bare; null where none does."""
    c = F.col
    forms = F.array(*[F.struct(F.lit(i).alias("place"), F.format_string(f, c("number")).alias("label")) for i, f in enumerate(("[%d]", "[E%d]", "%d"))])
    tried = asked.select("answer_id", "number").distinct().select("answer_id", "number", F.explode(forms).alias("f")).select("answer_id", "number", "f.place", "f.label")
    found = tried.join(labels, ["answer_id", "label"]).groupBy("answer_id", "number").agg(F.min_by("n", "place").alias("n"))
    return asked.join(found, ["answer_id", "number"], "left")


# The edit script

_MARKUP = re.compile(r"<a\b[^>]*>.*?</a>|<[^>]*>", re.S | re.I)
_PHRASE = re.compile(r"\[([^\]]{1,120})\]\(\s*(?:#(?:[a-z]+-cite-|cite-|e)?|cite:)([0-9]+)\s*\)", re.I)
_MARK = re.compile(r"(\[E?([0-9]+)\])(?:\s*\1)*(?!\()", re.I)
_SECTION = re.compile(r"\[(§[^\]]+)\](?!\()")
_NUMBER = re.compile(r"\[?[0-9]+\]?|E[0-9]+", re.I)
_CLAUSE = re.compile(r"(?<=[.!?。！？;；:：…])\s+")
_BULLET = re.compile(r"[\s·•\-*–—]+")
_PAGE = re.compile(r"\s+p\.[0-9]+(?:–[0-9]+)?\s*$", re.I)


@dataclass(frozen=True)
class Edit:
    start: int
    end: int
    priority: int
    text: str


@dataclass(frozen=True)
class Link:
    opening: str
    phrase: str

    def show(self, words: str = "") -> str:
        words = " ".join(words.split())[:VISIBLE] or self.phrase
        return f"{self.opening}{html.escape(words, quote=True).replace('&#x27;', '&#39;')}</a>"


def _phrase_before(text: str, low: int, mark: int) -> tuple[int, str] | None:
    """Where the phrase that stands before a mark begins, and its words: the last words of its clause, or its last characters where it is no Latin text."""
    end = low + len(text[low:mark].rstrip())
    begin = max(low, end - BEFORE)
    if mark - begin < 2:
        return None
    clause = begin
    for m in _CLAUSE.finditer(text, begin, end):
        clause = m.end()
    words = [m.span() for m in re.finditer(r"\S+", text[clause:end])]
    if not words:
        return None
    start = clause + words[0][0]
    if len(words) >= 2 and re.search("[A-Za-z]", text[clause:end]):
        start = clause + words[-min(WORDS, len(words))][0]
    elif end - start > TAIL:
        cut = re.compile(r"\S*\s+").match(text, end - TAIL, end)
        start = cut.end() if cut and cut.end() < end else end - (TAIL if not cut else TAIL_LEAST)
    bullet = _BULLET.match(text, start, end)
    start = bullet.end() if bullet else start
    return (start, text[start:end]) if end - start >= 2 else None


def edits(text: str, labels: dict[str, int], links: dict[int, Link]) -> list[Edit]:
    """What is to change in a text, overlaps and all: phrases with a link of their own, marks with the phrase before them, repeated marks, section marks."""
    of = lambda *names: next((links[labels[x]] for x in names if x in labels and labels[x] in links), None)
    number = lambda n: of(f"[{int(n)}]", f"[E{int(n)}]", str(int(n)))
    out = []
    for m in _PHRASE.finditer(text):
        if link := number(m[2]):
            words = " ".join(m[1].split())
            out.append(Edit(*m.span(), 0, link.show("" if not words or _NUMBER.fullmatch(words) else words)))
        else:
            out.append(Edit(*m.span(), 0, m[0]))
    # a phrase doesn't reach over a line end, a bracket, markup or what another mark takes
    low = 0
    for m in _MARK.finditer(text):
        link = number(m[2])
        if not link:
            out.append(Edit(*m.span(), 1, m[1]))
            continue
        edge = max(low, *(text.rfind(ch, 0, m.start()) + 1 for ch in "\n[]<>"))
        found = _phrase_before(text, edge, m.start())
        out.append(Edit(found[0] if found else m.start(), m.end(), 1, link.show(found[1] if found else "")))
        low = m.end()
    for m in _SECTION.finditer(text):
        base = _PAGE.sub("", m[1]).strip()
        if link := of(m[0], m[1], f"[{base}]", base):
            out.append(Edit(*m.span(), 2, link.show()))
    return out


def apply_edits(text: str, script: list[Edit]) -> str:
    """The text after its edits: none touches markup or a link, and of two that overlap the one of the lower priority number counts, then the earlier."""
    taken = [m.span() for m in _MARKUP.finditer(text)]
    chosen = []
    for e in sorted(script, key=lambda e: (e.priority, e.start)):
        if all(e.end <= a or e.start >= b for a, b in taken):
            taken.append((e.start, e.end))
            chosen.append(e)
    out, upto = [], 0
    for e in sorted(chosen, key=lambda e: e.start):
        out += [text[upto : e.start], e.text]
        upto = e.end
    return "".join(out) + text[upto:]


def linkify(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers(answer_id, answer) with ``linked``: cites of their evidence as links; answers without evidence, and null ones, stay as they are."""
    links = cite_links(evidence)
    c = F.col
    mine = links.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct("opening", "phrase")))).alias("__links"))
    named = cite_labels(links).groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("__labels"))

    @F.pandas_udf("string")
    def put(answer: pd.Series, labels: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, by, of in zip(answer, labels, found, strict=True):
            if text is None or not of:
                out.append(text)
                continue
            out.append(apply_edits(text, edits(text, dict(by), {n: Link(x["opening"], x["phrase"]) for n, x in dict(of).items()})))
        return pd.Series(out, dtype=object)

    joined = answers.join(mine, "answer_id", "left").join(named, "answer_id", "left")
    return joined.withColumn("linked", put(c("answer"), c("__labels"), c("__links"))).drop("__links", "__labels")


def _tray(items: Column) -> Column:
    """A list that folds, of items in markup; the empty string of none."""
    count = F.size(items).cast("string")
    head = F.concat(F.lit(f'<details class="evidence-tray">\n<summary>{EVIDENCE} '), count, F.lit('</summary>\n<ol class="evidence-list">\n'))
    return F.when(F.size(items) > 0, F.concat(head, F.array_join(items, "\n"), F.lit("\n</ol>\n</details>"))).otherwise("")


def _excerpt(text: Column) -> Column:
    return F.when(F.length(text) > EXCERPT, F.concat(F.trim(F.left(text, F.lit(EXCERPT - 1))), F.lit("…"))).otherwise(text)


def _item(opening: Column, phrase: Column, meta: Column, text: Column) -> Column:
    place = F.when(T.whole(meta) != "", F.concat(F.lit(' <span class="cite-meta">'), T.escape_html(meta), F.lit("</span>"))).otherwise("")
    return F.concat(F.lit("<li>"), opening, T.escape_html(phrase), F.lit("</a>"), place, F.lit(" — "), T.escape_html(text), F.lit("</li>"))


def evidence_trays(evidence: DataFrame) -> DataFrame:
    """(answer_id, tray, footer): the links of each answer's evidence as a folded list, and as lines of text."""
    c = F.col
    shown = default_phrase(c("preview"), c("label"), c("meta"), TRAY_PHRASE)
    item = _item(c("opening"), shown, c("meta"), F.coalesce(F.nullif(_excerpt(c("preview")), F.lit("")), F.lit(NO_EXCERPT)))
    tail = F.when(F.length("preview") >= EXCERPT_FROM, F.concat("preview", F.lit("…"))).otherwise(F.coalesce(F.nullif(c("preview"), F.lit("")), F.lit(NO_EXCERPT)))
    line = F.concat(F.lit("- "), "opening", T.escape_html(shown), F.lit("</a> — "), T.escape_html(tail))
    rows = cite_links(evidence).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("n", item.alias("item"), line.alias("line")))).alias("xs"))
    return rows.select("answer_id", _tray(c("xs.item")).alias("tray"), F.concat_ws("\n", F.lit(FOOTER), "xs.line").alias("footer"))


def ground_links(links: DataFrame) -> DataFrame:
    """grounding.links' rows with ``opening``, the tag that leads from their phrase to their sentence."""
    c = F.col
    return links.withColumns({"__page": c("page_start"), "meta": F.concat_ws(" · ", F.nullif(c("section"), F.lit("")), F.concat(F.lit("p."), c("page_start").cast("string")))}).withColumn(
        "opening", F.concat(
            F.lit('<a class="cite cite-phrase" href="'), F.coalesce(F.concat(F.lit("#page-"), c("__page").cast("string")), F.lit("#search")), F.lit('" title="'), T.escape_html(F.left(F.concat_ws(" · ", F.nullif(c("meta"), F.lit("")), "text"), F.lit(TITLE))), F.lit('"'),
            F.when(c("__page").isNotNull(), F.concat(F.lit(' data-page="'), c("__page").cast("string"), F.lit('"'))).otherwise(""), F.lit(' data-preview="'), T.escape_html(c("text")), F.lit('">'),
        )).drop("__page")


def insert_openings(answers: DataFrame, links: DataFrame) -> DataFrame:
    """answers(answer_id, answer) with ``linked``: the phrase of each of their links(answer_id, rank, phrase, opening), the longest first, as a link where it first stands outside markup and links.

    All are found on the answer as it is, and put in at once. Answers without links stay as they are.
    """
    gathered = links.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("rank", "phrase", "opening"))).alias("__links"))

    @F.pandas_udf("string")
    def put(answer: pd.Series, phrases: pd.Series, openings: pd.Series) -> pd.Series:
        return pd.Series([a if a is None or p is None else apply_edits(a, phrase_edits(a, list(zip(p, o, strict=True)))) for a, p, o in zip(answer, phrases, openings, strict=True)], dtype=object)

    return answers.join(gathered, "answer_id", "left").withColumn("linked", put(F.col("answer"), F.col("__links.phrase"), F.col("__links.opening"))).drop("__links")


def phrase_edits(answer: str, links: list[tuple[str, str]]) -> list[Edit]:
    """A link for each phrase at its first place that markup and longer phrases leave free."""
    low, taken, out = answer.lower(), [m.span() for m in _MARKUP.finditer(answer)], []
    for order, (phrase, opening) in enumerate(sorted(links, key=lambda x: -len(x[0]))):
        if len(phrase) < LEAST_PHRASE:
            continue
        at = low.find(phrase.lower())
        while at >= 0 and not all(at + len(phrase) <= a or at >= b for a, b in taken):
            at = low.find(phrase.lower(), at + 1)
        if at >= 0:
            taken.append((at, at + len(phrase)))
            out.append(Edit(at, at + len(phrase), order, f"{opening}{html.escape(answer[at : at + len(phrase)])}</a>"))
    return out


def ground_trays(links: DataFrame) -> DataFrame:
    """(answer_id, tray): the sentences that an answer's links lead to, each once, in order of rank."""
    c = F.col
    key = F.left(T.normalize_match(c("text")), F.lit(EXCERPT_FROM))
    once = ground_links(links).withColumn("__key", key).groupBy("answer_id", "__key").agg(F.min(F.struct("rank", "opening", "phrase", "meta", "text")).alias("x")).select("answer_id", "x.*")
    item = _item(c("opening"), c("phrase"), c("meta"), _excerpt(c("text")))
    rows = once.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("xs"))
    return rows.select("answer_id", _tray(c("xs.item")).alias("tray"))
