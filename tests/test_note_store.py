"""Notes found, read and saved; chats, stickies and summaries from notes or older files; automatic annotations; rectangles; prompts."""

import json

from pyspark.sql import functions as F

from lectern.operators import boxes, highlight, prompts
from lectern.operators import notes as N
from lectern.sources import note_store as S

NOTES = "parent string, note_id string, position int, tags array<string>, body string"


def body(kind, payload, quote='"', escape=True):
    text = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
    if escape:
        text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    return f"<div data-kind={quote}{kind}{quote}><pre class='x'>\n{text}\n</pre></div>"


def rows_of(spark):
    return spark.createDataFrame([
        ("a", "n2", 2, None, body("chat", [{"role": "user", "content": "late"}])), ("a", "n1", 1, [], body("CHAT", {"history": [{"role": "assistant", "content": "1 < 2 & \"so\""}]}, "'")),
        ("a", "n3", 3, ["lectern-sticky"], "no body"), ("a", "n4", 4, [], body("sticky", {"stickies": [{"id": "s"}]})),
        ("b", "m1", 1, ["lectern-summary", None], body("summary", {"markdown": " m\n"}, escape=False)), ("b", "m2", 2, None, None), ("b", "m3", 3, [], body("chat", "{broken")),
        ("unknown", "u", 1, [], body("chat", [{"role": "user", "content": "x"}])), (None, "z", 1, [], body("chat", [])), ("c", "e", 1, [], body("other", [])), ("c", "f", 1, [], ""),
    ], NOTES)


def test_find_and_read(spark):
    notes = rows_of(spark)
    found = {(r["parent"], r["kind"]): (r["note_id"], r["payload"] is not None) for r in S.find_notes(notes).collect()}
    assert found == {("a", "chat"): ("n1", True), ("a", "sticky"): ("n3", False), ("b", "summary"): ("m1", True), ("unknown", "chat"): ("u", True)}
    assert {(r["parent"], r["kind"]) for r in S.payloads_of(notes).collect()} == {("a", "chat"), ("b", "summary")}
    assert S.find_notes(notes.limit(0)).count() == 0
    assert [r["content"] for r in S.chat_turns(S.payloads_of(notes)).collect()] == ['1 < 2 & "so"']


def test_save_is_repeatable(spark):
    notes = rows_of(spark).withColumn("extra", F.lit(7))
    new = spark.createDataFrame([
        ("a", "chat", "[1]", 1), ("a", "chat", "[2]", 2), ("a", "chat", "[0]", 2), ("a", "sticky", "[3]", 1), ("a", "summary", "{}", 1), ("new", "chat", "[4]", 1), ("", "chat", "[5]", 1), (None, "chat", "[6]", 1),
        ("b", "other", "[7]", 1), ("b", "chat", None, 1),
    ], "parent string, kind string, payload string, at int")
    once = S.save_payloads(notes, new)
    assert once.columns == notes.columns and once.count() == notes.count() + 2
    got = {(r["parent"], r["kind"]): (r["payload"], r["note_id"]) for r in S.find_notes(once).collect()}
    assert got[("a", "chat")] == ("[2]", "n1") and got[("a", "sticky")] == ("[3]", "n3") and got[("a", "summary")][0] == "{}" and got[("new", "chat")][0] == "[4]" and got[("b", "summary")][1] == "m1"
    made = {r["parent"]: (r["position"], r["tags"], r["extra"]) for r in once.join(notes.select("note_id"), "note_id", "left_anti").collect()}
    assert made == {"a": (7, ["lectern-summary"], None), "new": (1, ["lectern-chat"], None)}
    tagged = {r["note_id"]: r["tags"] for r in once.collect()}
    assert tagged["n1"] == ["lectern-chat"] and tagged["n3"] == ["lectern-sticky"] and tagged["n2"] is None
    key = lambda df: sorted(map(str, df.collect()))
    assert key(S.save_payloads(once, new)) == key(once) and key(S.save_payloads(notes, new.limit(0))) == key(notes)


def plain_turns(payload, keep):
    """A chat by hand."""
    try:
        value = json.loads(payload)
    except (TypeError, ValueError):
        return []
    turns = value if isinstance(value, list) else value.get("history") if isinstance(value, dict) else None
    out = []
    for t in turns if isinstance(turns, list) else []:
        if isinstance(t, dict) and t.get("role") and t.get("content") is not None:
            image = t.get("imageDataUrl")
            image = image if image and len(image) <= N.CHAT_IMAGE else None
            out.append(("assistant" if t["role"] == "assistant" else "user", str(t["content"]), image, t.get("imageCaption") or None if image else None))
    return out[-keep:]


def test_chats_from_notes_and_files(spark):
    long = [{"role": "user", "content": f"turn {i} <&\"> \n 한"} for i in range(70)]
    odd = [{"role": "system", "content": 5}, {"role": "", "content": "x"}, {"content": "y"}, {"role": "user"}, None, 3, {"role": "user", "content": "i", "imageDataUrl": "d", "imageCaption": "c"},
           {"role": "user", "content": "j", "imageDataUrl": "d" * (N.CHAT_IMAGE + 1), "imageCaption": "c"}, {"role": "assistant", "content": "", "imageCaption": "c"}]
    texts = {"long": json.dumps(long), "odd": json.dumps({"history": odd}), "none": json.dumps({"history": []}), "bad": "{", "text": '"[1]"', "null": None, "unknown": json.dumps(odd)}
    payloads = spark.createDataFrame([(k, "chat", v) for k, v in texts.items()] + [("long", "sticky", json.dumps(odd))], "parent string, kind string, payload string")
    files = spark.createDataFrame([("none", json.dumps(odd)), ("long", json.dumps(odd)), ("only", json.dumps(long[:2])), ("bad", "[]")], "parent string, payload string")
    want = {k: ("note", plain_turns(v, 60)) for k, v in texts.items() if k != "unknown"} | {"none": ("file", plain_turns(json.dumps(odd), 60)), "only": ("file", plain_turns(json.dumps(long[:2]), 60))}
    got = {}
    for r in S.chat_turns(payloads, files).orderBy("parent", "turn").collect():
        got.setdefault(r["parent"], (r["source"], []))[1].append((r["role"], r["content"], r["image"], r["caption"]))
    assert got == {k: v for k, v in want.items() if v[1]}
    # what is saved reads back as it was
    turns = S.chat_turns(payloads, files)
    saved = S.save_payloads(spark.createDataFrame([], NOTES), S.chat_payloads(turns, "2024"))
    again = S.chat_turns(S.payloads_of(saved)).drop("source")
    assert sorted(map(str, again.collect())) == sorted(map(str, turns.drop("source").collect()))
    empty = S.save_payloads(saved, S.cleared_chats(turns.select("parent"), "2025"))
    assert empty.count() == saved.count() and S.chat_turns(S.payloads_of(empty)).count() == 0


def test_stickies_and_summaries(spark):
    many = [{"id": "s", "answer": "old", "createdAt": "2024-01-01", "x": 1.5}, {"id": "s", "answer": "new", "createdAt": "2024-01-02", "imageDataUrl": "d" * (N.STICKY_IMAGE + 1)}, {"id": "gone", "pinned": False}, {"id": ""}, {"answer": "no id"}, 4,
            {"id": "t", "pinned": None}]
    payloads = spark.createDataFrame([("a", "sticky", json.dumps({"stickies": many})), ("b", "sticky", "[]"), ("a", "summary", json.dumps({"markdown": " # m\n", "model": "", "provider": "p"})),
                                      ("b", "summary", json.dumps({"markdown": " \n"})), ("c", "summary", "[]")], "parent string, kind string, payload string")
    files = spark.createDataFrame([("b", json.dumps(many[:1])), ("a", json.dumps(many[:1]))], "parent string, payload string")
    found = S.stickies(payloads, files)
    assert {(r["parent"], r["id"], r["answer"], r["source"], r["imageDataUrl"]) for r in found.collect()} == {("a", "s", "new", "note", None), ("a", "t", None, "note", None), ("b", "s", "old", "file", None)}
    left = S.dismiss(found, spark.createDataFrame([("a", "s"), ("c", "s")], "parent string, id string"))
    assert {(r["parent"], r["id"]) for r in left.collect()} == {("a", "t"), ("b", "s")}
    assert {(r["parent"], r["collapsed"]) for r in S.collapse(left, True, F.col("parent") == "b").collect()} == {("a", None), ("b", True)}
    assert {r["collapsed"] for r in S.collapse(left, False).collect()} == {False}
    assert [tuple(r) for r in S.summaries(payloads).collect()] == [("a", "", "# m", "p", None)]
    again = S.summary_payloads(S.summaries(payloads), "2024")
    assert [tuple(r) for r in S.summaries(again).collect()] == [("a", "2024", "# m", "p", None)]


def test_automatic_annotations(spark):
    rows = spark.createDataFrame([
        (1, "k1", ["auto", "auto/method"], "q" * 500, "[Lectern · auto · method] x\nwhy", "3"), (1, "k2", ["auto/other", "auto/caveat", "auto/claim"], None, "plain", ""), (1, "k3", ["automatic"], "mine", None, "1"),
        (1, "k4", None, "mine", None, "1"), (2, "k1", ["mine"], "t", None, None), (2, "k5", ["auto"], "t", None, None), (2, "k5", [None, "mine"], "t", None, None),
    ], "doc_id int, key string, tags array<string>, text string, comment string, page_label string")
    got = {(r["doc_id"], r["key"]): tuple(r)[2:] for r in highlight.list_automatic(rows).collect()}
    assert got == {
        (1, "k1"): ("method", "q" * 400, "x\nwhy", "3", "#2ea8e5", "underline"), (1, "k2"): ("caveat", "", "plain", "?", "#ff6666", "underline"), (2, "k5"): ("claim", "t", "", "?", "#ffd400", "highlight"),
    }
    assert sorted((r["doc_id"], r["key"]) for r in highlight.without_automatic(rows).collect()) == [(1, "k3"), (1, "k4"), (2, "k1"), (2, "k5")]
    keys = spark.createDataFrame([(1, "k1"), (1, "k1"), (1, "k3"), (2, "k1"), (2, "k5")], "doc_id int, key string")
    assert sorted((r["doc_id"], r["key"]) for r in highlight.without_listed(rows, keys).collect()) == [(1, "k2"), (1, "k3"), (1, "k4"), (2, "k1"), (2, "k5")]
    places = spark.createDataFrame([("7", '{"pageIndex":2,"rects":[[1,2,3,4]]}'), ("7b", "{}"), ("0", "oops"), (None, None), ("iv", '{"rects":[]}')], "l string, p string")
    assert [tuple(r[0]) for r in places.select(highlight.annotation_place(F.col("l"), F.col("p"))).collect()] == [(2, [[1.0, 2.0, 3.0, 4.0]]), (6, None), (None, None), (None, None), (None, [])]


def test_rectangles(spark):
    rects = [[[1.005, 2.0, -1.255, 100.0, 9.0], [0.0, -0.001, 12345678.5, 0.1]], [[float("nan"), 1.0]], [[]], [], None, [[float(i), 0.0, 0.0, 0.0] for i in range(8)]]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(rects)], "i int, r array<array<double>>")
    texts = [r[0] for r in rows.orderBy("i").select(boxes.encode_rects(F.col("r"))).collect()]
    assert texts[:5] == ["[[1,2,-1.25,100],[0,0,12345678.5,0.1]]", "[[null,1]]", "[[]]", "", ""] and len(json.loads(texts[5])) == 6
    raws = [texts[0], "[[1,2,3]]", '[[1,2,3,4,5],"x",null,[1,2,"a",4],[1e2,2,3,4]]', "", None, "{}", "[[", "[]"]
    back = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i").select(boxes.parse_rects(F.col("r"))).collect()]
    assert back == [[[1.0, 2.0, -1.25, 100.0], [0.0, 0.0, 12345678.5, 0.1]], None, [[1.0, 2.0, 3.0, 4.0], [100.0, 2.0, 3.0, 4.0]], None, None, None, None, None]


def test_prompts(spark):
    rows = spark.createDataFrame([
        (0, "explain", "T", "see [1] there", "sel", None, False), (1, "explain", None, "near", "sel", "why?", True), (2, "figure-explain", "", "", None, "", None), (3, "chat", None, None, None, None, False),
    ], "i int, mode string, title string, context string, selection string, question string, image boolean")
    got = [r[0] for r in rows.orderBy("i").select(prompts.user_payload(*map(F.col, ("mode", "title", "context", "selection", "question", "image")))).collect()]
    assert got == [
        "Paper title: T\n\nPaper text:\nsee [1] there\n\nSelected text:\nsel\n\n" + prompts.EXPLAIN, "Nearby context:\nnear\n\nSelected text:\nsel\n\nUser question:\nwhy?\n\n" + prompts.IMAGE, prompts.FIGURE, "",
    ]
    asked = spark.createDataFrame([(1, 2, "b", "", "two", None, 3, None), (1, 1, "a", "Body", "one", 4, 1, 2), (2, 1, "c", None, None, None, None, None)],
                                  "doc_id int, rank int, id string, section string, text string, page_start int, para_start int, sent_start int")
    found = {r["doc_id"]: (r["n"], r["prompt"]) for r in highlight.candidate_prompts(asked).collect()}
    assert found == {1: (2, "### C1 [a] Body ¶1 s2 p.4\none\n\n### C2 [b] ¶3\ntwo"), 2: (1, "### C1 [c] \n")}
    assert highlight.candidate_prompts(asked.limit(0)).count() == 0
