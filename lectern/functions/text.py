"""Text functions as columns, native but for content_hash(): tokens, sizes, headings, paragraphs, sentences, anchors, hashes, escapes.

Patterns treat white space as Unicode does (no-break spaces and the byte-order mark included) and words
as ASCII. Null texts count as empty throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as characters and as one character of a pattern.
_WIDE = "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANKS = " \t\n\x0b\f\r\u00a0" + _WIDE
S = r"[\s\u00A0\uFEFF\p{Z}]"
#: Runs of white space but for single blanks.
RUNS = rf"{S}(?:(?<! ){S}*|{S}+)"
#: ASCII word boundaries.
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Section names that may stand as a heading, with an optional number before them.
SECTION_NAMES = (
    "Abstract", "Introduction", r"Related\s+Works?", "Background", "Preliminaries", "Method(?:s|ology)?", "Approach", "Experiments?", "Evaluation",
    "Results?", "Discussion", "Conclusions?", "Limitations", "Appendix", "References", "Acknowledgments?",
)
HEADING_LIMIT, SENTENCE_LIKE = 80, 40
# How numbers, titles and capitals of headings look, and how many words they have at most.
NAMED_HEADING = rf"(?i)^(?:(?:[0-9]+(?:\.[0-9]+){{0,3}}|[IVXLC]+)\.?\s+)?(?:{'|'.join(SECTION_NAMES)}){WORD_END}"
HEADING_NUMBER, ROMAN_NUMBER = r"^[0-9]+(?:\.[0-9]+){0,3}\.?\s+", r"^[IVXLC]{1,6}\.?\s+"
HEADING_TITLE, CAPITALS = r"[A-Z][\w'’\-/,:+ ]{1,60}\z", r"^[A-Z0-9][A-Z0-9\s\-&/]{2,50}\z"
NUMBERED_WORDS, CAPITAL_WORDS = 10, 8

# Abbreviations whose last full stop ends no sentence, in any case and as written.
ABBREVIATIONS, ABBREVIATIONS_AS_WRITTEN = (r"e\.g", r"i\.e", "et al"), ("Fig", "Eq", "Sec")
# in texts whose white space is squeezed; the blank comes first, as it is rarer than what may stand around it
SENTENCE_END = r""" (?<=[.!?] )(?=[\[A-Z0-9(“"])"""
# a stop and white space, or line ends: the lookbehind is tried at white space only
GROUND_END = rf"{S}(?:(?<=[.!?。！？]{S}){S}*|(?<=\n)\n*)"
DOT = "\ue000"
ANCHOR_SHORT, ANCHOR_LIMIT = 80, 320
#: Characters of a text that are read for its anchor, and of these, squeezed, those that an anchor can depend on.
ANCHOR_READ, ANCHOR_NEEDS = 1000, 400
GROUND_MINIMUM = 12
TOKEN = "[a-z가-힣]{2,}|[0-9]+"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(whole(text), RUNS, " "))


def _let(value: Column, of) -> Column:
    """of(value), with the value found once."""
    return F.transform(F.array(value), of)[0]


def lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def tokens(text: Column) -> Column:
    """Search tokens: lower case, parted between letters and digits; runs of a-z, 0-9 and Hangul of two characters up, or digits."""
    return F.regexp_extract_all(F.lower(whole(text)), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """How many tokens() a text has."""
    return F.regexp_count(F.lower(whole(text)), F.lit(TOKEN)).cast("long")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(whole(text), "UTF-16BE")) / 2).cast("int")


def estimate_tokens(text: Column) -> Column:
    """A token for every four UTF-16 units, at least one."""
    return F.greatest(F.lit(1), F.ceil(utf16_length(text) / 4)).cast("long")


def normalize_block(text: Column) -> Column:
    """No carriage returns, no blanks before line ends, no more than one blank line, none at the ends."""
    out = F.replace(whole(text), F.lit("\r"), F.lit(""))
    out = _let(out, lambda t: F.when(F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\t\n")), F.regexp_replace(t, "[ \t]+\n", "\n")).otherwise(t))
    return trim(_let(out, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t)))


def is_heading(line: Column) -> Column:
    """Whether a line looks like a section heading: a named section, a numbered or roman title, or a short line of capitals."""
    return F.transform(F.array(trim(whole(line))), _is_heading)[0]


def _is_heading(t: Column) -> Column:
    named, rest = t.rlike(NAMED_HEADING), F.regexp_replace(t, HEADING_NUMBER, "")
    few = lambda c, n: F.size(F.split(c, rf"{S}+")) <= n
    numbered = t.rlike(HEADING_NUMBER + HEADING_TITLE) & rest.rlike("[A-Za-z]{2,}") & few(rest, NUMBERED_WORDS)
    roman = t.rlike(ROMAN_NUMBER + HEADING_TITLE)
    capitals = t.rlike(CAPITALS) & few(t, CAPITAL_WORDS) & t.rlike("[A-Z]{3,}")
    prose = t.rlike(r"[.!?;:]\z") & (F.length(t) > SENTENCE_LIKE)
    return (t != "") & (F.length(t) < HEADING_LIMIT) & ~prose & (named | numbered | roman | capitals)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, none empty."""
    # without blank lines there is no need to look for them
    parts = _let(normalize_block(text), lambda t: F.when(t.rlike(r"\n\s*\n"), F.split(t, r"\n\s*\n+")).otherwise(F.array(t)))
    return F.filter(F.transform(parts, trim), lambda p: p != "")


def _sentence_parts(squeezed: Column, limit: int) -> Column:
    """A text, its white space squeezed, split where sentences end, into ``limit`` parts at most (-1: all); the last part is the rest."""
    abbreviation = rf"{WORD_START}((?i:{'|'.join(ABBREVIATIONS)})|{'|'.join(ABBREVIATIONS_AS_WRITTEN)})\."
    # most texts have none of them
    maybe = lambda low: F.exists(F.array(*[F.lit(f"{a.replace(chr(92), '').lower()}.") for a in ABBREVIATIONS + ABBREVIATIONS_AS_WRITTEN]), lambda a: F.contains(low, a))
    masked = _let(squeezed, lambda t: F.when(_let(F.lower(t), maybe) | F.contains(t, F.lit(DOT)), F.regexp_replace(t, abbreviation, f"$1{DOT}")).otherwise(t))
    return F.filter(F.transform(F.split(masked, SENTENCE_END, limit), lambda s: F.trim(F.replace(s, F.lit(DOT), F.lit(".")))), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences of academic prose: ended by . ! or ? before white space and a capital, a digit, an opening bracket or a quote."""
    return _sentence_parts(squeeze(text), -1)


def ground_sentences(text: Column) -> Column:
    """Sentences for grounding: ended by a stop before white space, or by a line end; of 12 characters up."""
    # line ends that follow one another part the text like one
    t = trim(F.replace(whole(text), F.lit("\r"), F.lit("")))
    parts = F.transform(F.split(t, GROUND_END), squeeze)
    return F.filter(parts, lambda p: F.length(p) >= GROUND_MINIMUM)


def anchor(text: Column) -> Column:
    """The first sentence, with the second if it is short, cut at 320."""
    read = lambda part: F.when((F.length(text) <= ANCHOR_READ) | (F.length(part) >= ANCHOR_NEEDS), F.left(part, F.lit(ANCHOR_NEEDS))).otherwise(F.left(squeeze(text), F.lit(ANCHOR_NEEDS)))

    def of(begins, found):
        first = F.coalesce(F.get(found, 0), begins)
        short = (F.length(first) < ANCHOR_SHORT) & (F.size(found) >= 2)
        return F.left(F.when(short, F.trim(F.concat_ws(" ", first, F.get(found, 1)))).otherwise(first), F.lit(ANCHOR_LIMIT))

    return _let(_let(squeeze(F.left(text, F.lit(ANCHOR_READ))), read), lambda begins: _let(_sentence_parts(begins, 3), lambda found: of(begins, found)))


def content_hash(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units as eight hex digits, then the number of units in hex."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h, units = 0x811C9DC5, np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2").tolist()
            for u in units:
                h = ((h ^ u) * 0x01000193) & 0xFFFFFFFF
            out.append(f"{h:08x}{len(units):x}")
        return pd.Series(out, dtype=object)

    return of(whole(text))


def normalize_match(text: Column) -> Column:
    return F.lower(squeeze(text))


def compact(text: Column) -> Column:
    """Lower-cased letters a-z and digits alone."""
    return F.regexp_replace(F.lower(whole(text)), "[^a-z0-9]+", "")


# Lengths of previews, of first sentences that stand alone, and of what is left after one.
PREVIEW, PREVIEW_LEAST, PREVIEW_SHORT, PREVIEW_REST = 320, 40, 80, 10


def section_base(section: Column) -> Column:
    """A section's name without the number of its part."""
    return F.regexp_replace(section, rf"{S}*\([0-9]+\){S}*\z", "")


def _span(mark: str, low: Column, high: Column) -> Column:
    return F.when(low.isNull(), None).when(high.isNotNull() & (high != low), F.concat(F.lit(mark), low, F.lit("–"), high)).otherwise(F.concat(F.lit(mark), low))


def locator(section: Column, para: tuple[Column, Column], sent: tuple[Column, Column], page: tuple[Column, Column]) -> Column:
    """Section, paragraphs, sentences (of a single paragraph) and pages, with dots between those there are."""
    one = para[1].isNull() | (para[1] == para[0])
    return F.concat_ws(" · ", section_base(section), _span("¶", *para), F.when(one, _span("s", *sent)), _span("p.", *page))


def locator_suffix(para: tuple[Column, Column], sent: tuple[Column, Column]) -> Column:
    """Paragraphs and, of a single one, sentences, each after a space; empty without a paragraph."""
    one = para[1].isNull() | (para[1] == para[0])
    spaced = lambda c: F.coalesce(F.concat(F.lit(" "), c), F.lit(""))
    return F.when(para[0].isNull(), "").otherwise(F.concat(spaced(_span("¶", *para)), F.when(one, spaced(_span("s", *sent))).otherwise("")))


def cite_preview(text: Column, most: int = PREVIEW) -> Column:
    """A text's first sentence, with the second if it is short, for finding it on a page; without a sentence of fitting length, the text's beginning. Null gives the empty string."""
    first = lambda c: F.regexp_extract(c, r"(?s)^(.+?[.!?])(?: +|\z)", 1)

    def of(t, m):
        n = F.length(m)
        rest = F.trim(F.substring(t, n + 1, F.length(t)))
        both = F.concat(m, F.lit(" "), F.coalesce(F.nullif(first(rest), F.lit("")), rest))
        short = (n < PREVIEW_SHORT) & (F.length(t) > n + PREVIEW_REST)
        return F.when(n.between(PREVIEW_LEAST, most), F.when(short, F.trim(F.left(both, F.lit(most)))).otherwise(m)).otherwise(F.left(t, F.lit(most)))

    parts = F.transform(F.array(squeeze(text)), lambda t: F.struct(t.alias("t"), first(t).alias("m")))
    return F.transform(parts, lambda p: of(p["t"], p["m"]))[0]


def cite(section: Column, para: Column, sent: Column, page: Column) -> Column:
    """[§section ¶para s sent p.page], with what there is."""
    return F.concat(F.lit("[§"), F.concat_ws(" ", section, F.concat(F.lit("¶"), para), F.concat(F.lit("s"), sent), F.concat(F.lit("p."), page)), F.lit("]"))


def evidence_id(rank: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("]"))


#: Characters and their entities.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(text: Column, quote: bool = True) -> Column:
    """Markup characters as entities; the single quote only if asked for."""
    out = whole(text)
    for c, e in ESCAPES if quote else ESCAPES[:-1]:
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def unescape_html(text: Column) -> Column:
    """The four entities of note bodies as characters."""
    out = whole(text)
    for c, e in reversed(ESCAPES[:-1]):
        out = F.replace(out, F.lit(e), F.lit(c))
    return out


def strip_cites(text: Column) -> Column:
    """A model's own citation marks and phrase links removed."""
    out = F.regexp_replace(whole(text), r"\[([^\]]+)\]\(#cite-[^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)\[E?[0-9]+\](?!\()", ""), r"\[§[^\]]+\]", "")


def merge_repeated_cites(text: Column) -> Column:
    return F.regexp_replace(whole(text), r"(\[E?[0-9]+\])(?:\s*\1)+", "$1")


def search_needle(text: Column, skip: int = 4, take: int = 10) -> Column:
    """Words longer than two characters, without the first few, at most ten."""
    found = F.filter(F.split(squeeze(text), " "), lambda w: F.length(w) > 2)
    skipped = F.least(F.lit(skip), F.greatest(F.lit(0), F.size(found) - take))
    return F.transform(F.array(found), lambda f: F.array_join(F.slice(f, skipped + 1, F.lit(take)), " "))[0]


def strip_tags(html: Column) -> Column:
    """Tags as spaces, white space squeezed."""
    return squeeze(F.regexp_replace(whole(html), "<[^>]+>", " "))


def normalize_color(color: Column) -> Column:
    """#rgb, #rrggbb and #rrggbbaa as #rrggbb in lower case; else null."""
    c = F.lower(F.trim(color))
    short = F.concat(F.lit("#"), *[F.repeat(F.substring(c, i, 1), F.lit(2)) for i in (2, 3, 4)])
    return F.when(c.rlike("^#[0-9a-f]{3}$"), short).when(c.rlike("^#[0-9a-f]{6}(?:[0-9a-f]{2})?$"), F.left(c, F.lit(7)))


def round_half_up(value: Column, digits: int) -> Column:
    """Halves towards plus infinity, also below zero."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


#: Functions by the names they get in SQL.
SQL_FUNCTIONS = {"tokenize": tokens, "est_tokens": estimate_tokens, "content_hash": content_hash, "split_paragraphs": paragraphs, "split_sentences": sentences}
