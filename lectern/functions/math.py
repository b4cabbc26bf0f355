"""Mathematics in Markdown: the usual ways to mark it, as dollar signs.

One scan over the marks of a text. What a region holds (a code fence, code in a line, mathematics, an environment) is never looked into again, and the end of a region
is found by moving on in the list of its marks; so the cost is in proportion to the text, also where marks are left open.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages of fences that hold mathematics, environments that are taken off and that are kept.
FENCES, TAKEN_OFF, KEPT = ("math", "latex", "tex", "katex"), ("equation", "equation*"), ("align", "align*", "aligned", "gather", "gather*", "multline", "multline*")

_ENVIRONMENT = "|".join(map(re.escape, sorted((*TAKEN_OFF, *KEPT), key=len, reverse=True)))
_MARK = re.compile(rf"\$\$|```|`|\\[\[\](){{}}]|\\(?:begin|end)\{{(?:{_ENVIRONMENT})\}}|\n")
_FENCE = re.compile(rf"(?:{'|'.join(FENCES)})\s*?\r?\n", re.I)
_CLOSES = {"$$": "$$", "```": "```", "`": "`", "\\[": "\\]", "\\(": "\\)"} | {f"\\begin{{{e}}}": f"\\end{{{e}}}" for e in (*TAKEN_OFF, *KEPT)}


def _display(inner: str) -> str:
    return f"\n$$\n{inner}\n$$\n"


def _region(mark: str, text: str, inner_start: int, inner_end: int, end: int, start: int) -> str:
    """What a region becomes."""
    inner = text[inner_start:inner_end]
    if mark == "```":
        fence = _FENCE.match(inner)
        return _display(inner[fence.end() :].strip()) if fence else text[start:end]
    if mark == "\\(":
        return f"${inner.strip()}$"
    if mark == "\\[":
        return _display(inner.strip())
    if mark.startswith("\\begin"):
        return _display(inner.strip() if mark[7:-1] in TAKEN_OFF else text[start:end])
    return text[start:end]


def dollars(text: str) -> str:
    """A text with its mathematics in dollar signs; marks without an end stay as they are."""
    marks = [(m.start(), m.end(), m[0]) for m in _MARK.finditer(text)]
    places: dict[str, list[tuple[int, int]]] = {}
    for start, end, mark in marks:
        places.setdefault(mark, []).append((start, end))
    next_of, out, upto = dict.fromkeys(places, 0), [], 0

    def after(mark: str, at: int) -> tuple[int, int] | None:
        found, i = places.get(mark, []), next_of.get(mark, 0)
        while i < len(found) and found[i][0] < at:
            i += 1
        next_of[mark] = i
        return found[i] if i < len(found) else None

    for start, end, mark in marks:
        if start < upto or mark not in _CLOSES:
            continue
        close = after(_CLOSES[mark], end + (mark == "$$"))
        if close is None:
            continue
        if mark == "`" and (line := after("\n", end)) and line[0] < close[0]:
            continue
        out += [text[upto:start], _region(mark, text, end, close[0], close[1], start)]
        upto = close[1]
    return "".join(out) + text[upto:]


def normalize_math(text: Column) -> Column:
    """dollars() of each text; null stays null."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else dollars(t) for t in texts], dtype=object)

    return of(text)
