"""From a question to a linked answer in one call."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, cites, tasks
from lectern.sources.tables import stored

TEXT = "The adaptive controller reduces tracking errors by a third. Nothing else in this text is of any use to anyone. Batteries last twice as long in cold weather than before."
ASKED = "query_id long, doc_id long, query string, selection string, bias string, task string"


def spoken(answers):
    """A model that says what is set down for the first word that its prompt ends with; made here, so that workers get it by value."""
    class Spoken:
        name = "spoken"

        def open(self):
            return lambda prompts: [(i, answers[p.split()[-1]]) for i, p in enumerate(prompts)]

    return Spoken()


def test_links_and_tray(spark):
    chunks = stored(chunking.chunk_documents(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")))
    rows = [
        (1, 1, "- The adaptive controller reduces tracking errors by a third [1].\n- Batteries last twice as long in [cold weather](#cite-2) than before [§Body ¶1]."), (2, 1, "The moon is made of green cheese, as all of us know."), (3, 1, "  "), (4, 1, None),
        (5, 9, "The adaptive controller reduces tracking errors [1]."), (6, None, "of no document"),
    ]
    found = {r.answer_id: r for r in tasks.link_answers(spark.createDataFrame(rows, "answer_id long, doc_id long, answer string"), chunks).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6}
    one = found[1]
    assert one.matched == 2 and one.n_claims == 2 and one.linked.endswith("\n\n" + one.tray) and "[1]" not in one.linked and "[§" not in one.linked and "#cite-2" not in one.linked
    body = one.linked[: -len(one.tray) - 2]
    assert body.count('<a class="cite cite-phrase" href="#search"') == 2 and body.startswith("- ") and "</a>" in body.split("\n")[0] and "</a>" in body.split("\n")[1]
    assert one.tray.startswith('<details class="evidence-tray">\n<summary>근거 2</summary>') and one.tray.count("<li>") == 2 and "Batteries last twice as long in cold weather than before." in one.tray
    assert (found[2].linked, found[2].tray, found[2].matched, found[2].n_claims) == (rows[1][2], "", 0, 1)
    assert (found[3].linked, found[4].linked, found[3].n_claims) == ("  ", "", 0) and found[5].linked == rows[4][2] and found[5].n_claims == 0 and found[6].matched == 0
    none = tasks.link_answers(spark.createDataFrame([], "answer_id long, doc_id long, answer string"), chunks)
    assert none.collect() == []


def test_questions_to_answers(spark):
    chunks = stored(chunking.chunk_documents(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")))
    rows = [(1, 1, "what of errors", "", "", "chat"), (2, 1, "please translate", "", "", "translate"), (3, 7, "no document", "", "", "chat"), (4, 1, "what of errors", None, None, "chat")]
    model = spoken({"errors": "The adaptive controller reduces tracking errors by a third.", "translate": "The adaptive controller reduces tracking errors by a third.", "document": "none"})
    found = {r.query_id: r for r in tasks.answer_questions(chunks, spark.createDataFrame(rows, ASKED), spark.createDataFrame([(1, "One")], "doc_id long, title string"), model).collect()}
    assert [found[q].used_rag for q in (1, 2, 3, 4)] == [True, False, False, True]
    assert found[1].linked == found[4].linked and found[1].matched == 1 and "</a>" in found[1].linked and found[2].linked == found[2].answer == found[1].answer and found[3].linked == "none"
    assert found[1].context_block.startswith("Paper: One")


def test_a_model_that_leaves_one_out(spark):
    class Silent:
        name = "silent"

        def open(self):
            return lambda prompts: []

    with pytest.raises(Exception, match="1 prompts failed 3 times"):
        tasks.ask(spark.createDataFrame([("x",)], "p string"), "p", Silent()).collect()
    assert tasks.ask(spark.createDataFrame([(None, 1)], "p string, answer int"), "p", Silent()).collect()[0].answer is None


def test_marks_go(spark):
    rows = spark.createDataFrame([("a [1] b [E2][§X ¶1] [c d](#cite-3) [e](http://x) [4](y)",), (None,)], "t string")
    assert [r[0] for r in rows.select(tasks.without_marks(F.col("t"))).collect()] == ["a  b  c d [e](http://x) [4](y)", ""]


def test_phrases_are_put_in_once():
    text = 'See <a href="x">the controller</a> and the controller reduces & more'
    script = cites.phrase_edits(text, [("the controller", "<1>"), ("reduces &", "<2>"), ("xx", "<3>"), ("controller reduces", "<4>")])
    assert cites.apply_edits(text, script) == 'See <a href="x">the controller</a> and the <4>controller reduces</a> &amp; more'.replace("&amp;", "&")
