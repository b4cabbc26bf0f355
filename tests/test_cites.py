"""Cites: links, labels and the edit script against plain models."""

import html

from pyspark.sql import functions as F

from lectern.operators import cites

SCHEMA = (
    "answer_id long, n int, cite string, section string, para_start int, para_end int, sent_start int, sent_end int, page_start int, page_end int, page_index0 int, "
    "anchor_text string, context_text string, text string, rects array<struct<x1:double,y1:double,x2:double,y2:double>>"
)
WORDS = "The controller reduces tracking errors by a third of what it was before."


def row(a, n, cite=None, section=None, place=(None,) * 4, pages=(None, None, None), anchor=None, context=None, text=None, rects=None):
    return (a, n, cite, section, *place, *pages, anchor, context, text, rects)


def links_of(spark, rows):
    return cites.cite_links(spark.createDataFrame(rows, SCHEMA))


def test_first_wins_and_aliases_lead_to_it(spark):
    rows = [
        row(1, 0, None, "Results", (2, 2, 1, 3), (4, 4, None), WORDS), row(1, 1, None, "Results", (2, 2, 1, 3), (5, None, None), None, WORDS), row(1, 2, "[1]", "Other", text="never seen"),
        row(1, 3, "[§Results ¶2 s1–3 p.4]", "Results", text="its cite is an alias of the first"), row(1, 4, "", None), row(2, 0, None, "§Intro", (1, 3, None, None), (None, None, 6), text="short"),
        row(2, 1, "[E7]", "Results", text="x"), row(None, 0, None, None),
    ]
    got = {(r.answer_id, r.n): r for r in links_of(spark, rows).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 4), (2, 0), (2, 1), (None, 0)}
    assert got[1, 0].aliases == ["[§Results ¶2 s1–3 p.4]", "[§Results]", "[§Results ¶2 s1–3]", "[E1]"] and got[1, 1].aliases == ["[§Results ¶2 s1–3 p.5]", "[E2]"]
    assert got[2, 0].page_start == 7 and got[2, 0].aliases == ["[§Intro ¶1–3]", "[§Intro]", "[E1]"] and got[2, 1].label == "E7" and got[1, 4].cite == "[5]"
    assert got[1, 0].phrase == "The controller reduces tracking errors by" and got[2, 0].phrase == "§Intro" and got[1, 4].phrase == "근거 5"
    assert links_of(spark, []).collect() == []


def test_labels_and_resolution(spark):
    rows = [row(1, 0, None, "A", text=WORDS), row(1, 1, "[E2]", "A", text=WORDS), row(1, 2, "[§A]", "B", text=WORDS), row(2, 0, "[x]", "A", text=WORDS)]
    labels = cites.cite_labels(links_of(spark, rows))
    got = {(r.answer_id, r.label): r.n for r in labels.collect()}
    assert got[1, "[1]"] == got[1, "1"] == got[1, "E1"] == got[1, "[e1]"] == got[1, "[§A]"] == got[1, "§A"] == 0 and got[1, "[2]"] == got[1, "[e2]"] == got[1, "E2"] == 1
    # the cite of the third is an alias of the first, so the third is no link
    assert 2 not in got.values() and got[2, "[x]"] == got[2, "x"] == 0
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 9), (2, 1), (None, 1), (1, None)], "answer_id long, number int")
    assert sorted(map(str, cites.resolve(asked, labels).select("answer_id", "number", "n").collect())) == sorted(
        f"Row(answer_id={a}, number={n}, n={x})" for a, n, x in [(1, 1, 0), (1, 2, 1), (1, 2, 1), (1, 9, None), (2, 1, None), (None, 1, None), (1, None, None)])


LINKS = {0: cites.Link('<a class="c" title="t [2] x">', "default one"), 1: cites.Link("<a>", "default two")}
LABELS = {"[1]": 0, "[E1]": 0, "1": 0, "[2]": 1, "2": 1, "[§Results]": 0, "§Results": 0, "[§Results ¶2 p.4]": 1}


def linked(text):
    out = cites.apply_edits(text, cites.edits(text, LABELS, LINKS))
    assert cites.apply_edits(out, cites.edits(out, LABELS, LINKS)) == out
    return out.replace(LINKS[0].opening, "<1>").replace(LINKS[1].opening, "<2>").replace("</a>", "</>")


def test_edit_script():
    cases = {
        "": "", "no cites": "no cites",
        "It [learns forces](#cite-1) well": "It <1>learns forces</> well", "a [x y](#e2) b [z]( cite:1 ) [q](#other-cite-2)": "a <2>x y</> b <1>z</> <2>q</>",
        "[1](#cite-1) and [E2](cite:2)": "<1>default one</> and <2>default two</>", "kept [p](#cite-9) and [9]": "kept [p](#cite-9) and [9]",
        "residual force learning [1]": "<1>residual force learning</>", 
        # the comma that follows a mark belongs to the phrase of the next one
        "So it is. Then force learning [E1], and more [2].": "So it is. <1>Then force learning</><2>, and more</>.",
        "one two three four five six seven eight nine ten [1]": "one two <1>three four five six seven eight nine ten</>",
        "[1] first": "<1>default one</> first", "words here [1][1] [1] end": "<1>words here</> end", "words [9] [9] [9]": "words [9]",
        "a\n- bullet point [2]": "a\n- <2>bullet point</>",
        "<a href='#'>the link [1]</a> more [1]": "<a href='#'>the link [1]</> <1>more</>",
        "<b title='[1]'>bold</b>": "<b title='[1]'>bold</b>", "see [§Results ¶2 p.4] and [§Results p.7] and [§None]": "see <2>default two</> and <1>default one</> and [§None]",
        "x < y & z [1]": "x < <1>y &amp; z</>",
    }
    for text, want in cases.items():
        assert linked(text) == want, text


def test_korean_and_long_phrases():
    text = "가" * 100 + " [1]"
    assert linked(text) == "가" * 52 + "<1>" + "가" * 48 + "</>"
    text = "나" * 30 + " " + "다" * 40 + " [2]"
    assert linked(text) == "나" * 30 + " <2>" + "다" * 40 + "</>"


def test_linkify_a_table(spark):
    rows = [row(1, 0, None, "Results", (2, 2, 1, 1), (4, 4, None), WORDS, rects=[(1.0, 2.005, 3.5, 4.0)]), row(2, 0, text='a "quoted" text & more of it')]
    answers = spark.createDataFrame([(1, "it works [1]", 5), (2, "so [1]", 6), (3, "none [1]", 7), (1, None, 8), (None, "x [1]", 9)], "answer_id long, answer string, n int")
    got = {r.n: r.linked for r in cites.linkify(answers, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[7] == "none [1]" and got[8] is None and got[9] == "x [1]"
    assert got[5] == (
        f'<a class="cite cite-phrase" href="#page-4" title="Results · ¶2 · s1 · p.4 · {WORDS}" data-eid="1" data-page="4" data-preview="{WORDS}" data-rects="[[1,2.01,3.5,4]]">it works</a>'
    ) or got[5].endswith(">it works</a>")
    assert 'data-preview="a &quot;quoted&quot; text &amp; more of it"' in got[6] and got[6].endswith(">so</a>") and 'href="#search"' in got[6]
    trays = {r.answer_id: r for r in cites.evidence_trays(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert trays[1].tray.startswith('<details class="evidence-tray">\n<summary>근거 1</summary>\n<ol class="evidence-list">\n<li><a ') and trays[1].tray.endswith(f"</span> — {WORDS}</li>\n</ol>\n</details>")
    assert trays[2].footer.split("\n")[1].endswith(f"</a> — {html.escape('a "quoted" text & more of it')}")


def test_rects_there_and_back(spark):
    frame = spark.createDataFrame([([(1.0, 2.5, 3.125, 4.0)] * 8,), ([],), (None,)], "r array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = frame.select(cites.encode_rects(F.col("r")).alias("s")).select("s", cites.parse_rects(F.col("s")).alias("r")).collect()
    assert got[0].s == "[" + ",".join(["[1,2.5,3.13,4]"] * 6) + "]" and len(got[0].r) == 6 and got[1].s == got[2].s == "" and got[1].r is None
    odd = spark.createDataFrame([("[[1,2,3]]",), ("[[1,2,3,4,5],[1,null,2,3]]",), ("{",), (None,)], "s string").select(cites.parse_rects(F.col("s"))).collect()
    assert [x[0] and [tuple(r) for r in x[0]] for x in odd] == [None, [(1.0, 2.0, 3.0, 4.0)], None, None]
