"""What a model is asked with: the blocks of a question in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a context holds that is made of retrieved passages; the heads of blocks; the tasks of modes that ask nothing themselves.
PASSAGE_MARKS = ("Full paper context", "Relevant passages", "Evidence passages", "Citeable passages", "Paper text", "[1]", "[E1]", "[§")
TITLE, PASSAGES, NEARBY, SELECTION, QUESTION = "Paper title: ", "Paper text:\n", "Nearby context:\n", "Selected text:\n", "User question:\n"
IMAGE = "An image of the selected figure/region is attached."
EXPLAIN = "Task: explain the selected text in the paper's context."
FIGURE = "Task: explain the attached figure/region and how it supports the paper."


def is_passages(context: Column) -> Column:
    """Whether a context is made of retrieved passages."""
    found = F.lit(False)
    for mark in PASSAGE_MARKS:
        found = found | F.contains(context, F.lit(mark))
    return found


def user_payload(mode: Column, title: Column, context: Column, selection: Column, question: Column, has_image: Column) -> Column:
    """The blocks that there are, two line feeds between them: title, context, selection, question, image, task. Null and empty parts have no block; without any the result is empty."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    block = lambda head, c: F.when(some(c), F.concat(F.lit(head), c))
    around = F.when(is_passages(context), block(PASSAGES, context)).otherwise(block(NEARBY, context))
    tasks = F.when((mode == "explain") & some(selection) & ~some(question), EXPLAIN), F.when((mode == "figure-explain") & ~some(question), FIGURE)
    return F.concat_ws("\n\n", block(TITLE, title), around, block(SELECTION, selection), block(QUESTION, question), F.when(has_image, IMAGE), *tasks)
