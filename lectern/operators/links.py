"""Links from an answer's phrases to the sentences that support them; string surgery, so Arrow functions over whole batches."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# How long a phrase must and may be, and how long its tokens.
PHRASE_MINIMUM, PHRASE_MAXIMUM, SHARED_TOKEN, SHARED_TOKENS, STRONG_TOKEN, LINK_MINIMUM = 6, 80, 4, 5, 7, 3


def longest_common_run(a: list[str], b: list[str]) -> list[str]:
    """The first of the longest runs of tokens that both have."""
    best, at, before = 0, 0, [0] * (len(b) + 1)
    for i, t in enumerate(a):
        row = [0] * (len(b) + 1)
        for j, u in enumerate(b):
            if t == u:
                row[j + 1] = before[j] + 1
                if row[j + 1] > best:
                    best, at = row[j + 1], i + 1
        before = row
    return a[at - best : at]


def surface(claim: str, tokens: list[str]) -> str:
    """How the claim writes the tokens: together if it does, else from the first one on as far as they follow each other."""
    low, joined = claim.lower(), " ".join(tokens)
    if (at := low.find(joined)) >= 0:
        return claim[at : at + len(joined)]
    start = re.search(rf"(?<!\w){re.escape(tokens[0])}(?!\w)", low, re.A)
    at = start.start() if start else low.find(tokens[0])
    if at < 0:
        return joined
    end = at
    for t in tokens:
        follow = re.compile(rf"\W*{re.escape(t)}", re.A).match(low, end)
        if not follow:
            break
        end = follow.end()
    found = claim[at:end].strip()
    return found if len(found) >= 3 else joined


def phrase(claim: str, claim_tokens: list[str], sentence_tokens: list[str]) -> str | None:
    """A short phrase of the claim that the sentence has as well: a common run, shared longer tokens, or one strong one; it must stand in the claim."""
    if len(claim_tokens) < 2 or len(sentence_tokens) < 2:
        return None
    have = set(sentence_tokens)
    run = longest_common_run(claim_tokens, sentence_tokens)
    shared = [t for t in claim_tokens if len(t) >= SHARED_TOKEN and t in have]
    strong = [t for t in claim_tokens if len(t) >= STRONG_TOKEN and t in have][:1]
    choices = [(run, 2, PHRASE_MINIMUM), (shared[:SHARED_TOKENS] if len(shared) >= 2 else [], 2, PHRASE_MINIMUM), (strong, 1, 1)]
    for tokens, least, size in choices:
        if len(tokens) >= least and len(found := surface(claim, tokens)) >= size:
            found = found[:PHRASE_MAXIMUM]
            return found if found.lower() in claim.lower() else None
    return None


def link_phrase(claim: Column, claim_tokens: Column, sentence_tokens: Column) -> Column:
    """The phrase() of each row. It counts as not deterministic, so that a filter on it doesn't make Spark run it twice."""
    @F.pandas_udf("string")
    def pick(c: pd.Series, ct: pd.Series, st: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else phrase(x, list(a), list(b)) for x, a, b in zip(c, ct, st, strict=True)], dtype=object)

    return pick.asNondeterministic()(claim, claim_tokens, sentence_tokens)


def insert_links(answer: str, links: list[tuple[str, str]]) -> str:
    """The answer with each link's phrase, the longest first, as an anchor to its target where it first stands outside markup and other links."""
    spans: list[tuple[int, int, str]] = []
    markup = [m.span() for m in re.finditer(r"<a\b.*?</a>|<[^>]*>", answer, re.S)]
    low = answer.lower()
    for text, target in sorted(links, key=lambda x: -len(x[0])):
        if len(text) < LINK_MINIMUM:
            continue
        at = low.find(text.lower())
        while at >= 0:
            end = at + len(text)
            if all(end <= a or at >= b for a, b in [*markup, *((s[0], s[1]) for s in spans)]):
                spans.append((at, end, target))
                break
            at = low.find(text.lower(), end)
    out, upto = [], 0
    for a, b, target in sorted(spans):
        out += [answer[upto:a], f'<a href="{html.escape(target)}">', html.escape(answer[a:b], quote=False), "</a>"]
        upto = b
    return "".join(out) + answer[upto:]


def apply_links(answers: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """answers(by, answer) with ``linked``: their links(by, phrase, target) put in; answers without any stay as they are."""
    gathered = links.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "phrase", "target"))).alias("__links"))

    @F.pandas_udf("string")
    def put(answer: pd.Series, phrases: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([a if a is None or p is None else insert_links(a, list(zip(p, t, strict=True))) for a, p, t in zip(answer, phrases, targets, strict=True)], dtype=object)

    joined = answers.join(gathered, by, "left")
    return joined.withColumn("linked", put(F.col("answer"), F.col("__links.phrase"), F.col("__links.target"))).drop("__links")
