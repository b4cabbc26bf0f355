import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern.llm import brown, htmlcut, langid, pii, urlfilter
from lectern.llm.common import cut

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or k == "card" and 13 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return out


def test_personal_data_against_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    bits = ["a.b@c.d.e", "_x@y.org", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1 (988) 555-2485", "4111-1111 1111 1111", "4111111111111112", "😀", "10.0.0.25", "00001.2.3.4", "@", "+", "é", " ", "x", "5500005555555559", "+33 1 23 45 67 89", ".", "-", "٣"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " ", "\n", "."]) for _ in range(rnd.randint(0, 14))) for _ in range(200)] + [None, "", "1" * 3000, "a." * 2000 + "@", "call me at (415) 555-2671 or write to john.doe [at] example [dot] com please"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (t, base, rows[i]["spans"])
        assert set(filter(None, base.split(","))) <= set(rows[i]["spans"].split(",")) | {""}
    assert rows[len(texts) - 1]["spans"] == "email:38:69,phone:11:25"


def test_personal_data_in_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(docs, "text", ["doc_id"]).count() == 0


def test_votes_are_weighed_by_reliability(spark):
    rows = [("phone", [1, 1, 1, 0, 1, 1])] * 50 + [("phone", [0, -1, -1, -1, 0, -1])] * 50 + [("phone", [0, 1, 1, 1, 1, 1])] * 3
    found = {tuple(r["votes"]): r["likelihood"] for r in pii.reliabilities(spark.createDataFrame(rows, "kind string, votes array<int>")).collect()}
    assert found[(1, 1, 1, 0, 1, 1)] > 0.95 and found[(0, -1, -1, -1, 0, -1)] < 0.05 and found[(0, 1, 1, 1, 1, 1)] > 0.8


LANGS = {"en": "the of and to in that with for this from which have".split(), "de": "der die und das nicht mit auf für ist ein eine werden".split(), "fr": "le la les des une dans pour qui avec sur être nous".split()}


def text_of(lang, rnd, n):
    return " ".join(rnd.choice(LANGS[lang]) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rnd = random.Random(6)
    rows = [(i, text_of(lang, rnd, rnd.randint(15, 60)), lang) for i, lang in enumerate(list(LANGS) * 100)]
    docs = spark.createDataFrame(rows + [(900, "a b", None), (901, None, "en"), (902, "12 34", "de")], "doc_id long, text string, lang string")
    model = langid.fit_on(docs)
    assert model.names == ("de", "en", "fr")
    asked = spark.createDataFrame([(i, text_of(lang, rnd, 25), lang) for i, lang in enumerate(list(LANGS) * 30)] + [(200, None, "x"), (201, "", "x"), (202, "123 !?", "x"), (203, text_of("fr", rnd, 9000), "fr")], "doc_id long, text string, score string")
    found = langid.identify(asked, "text", model).collect()
    assert len(found) == 94
    known = [r for r in found if r["doc_id"] < 90 or r["doc_id"] == 203]
    truth = {i: lang for i, lang in enumerate(list(LANGS) * 30)} | {203: "fr"}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in known) >= 0.97 * len(known)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in found if 200 <= r["doc_id"] <= 202)
    nothing = langid.fit_on(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(asked, "text", nothing).collect()} == {"und"}


def test_brown_base_scores_and_probabilities(spark, tmp_path):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(50)] + ["Été", "ÉTÉ"]
    texts = {i: " ".join(rnd.choice(vocabulary[: 5 + i % 48]) for _ in range(rnd.randint(0, 60))) for i in range(120)} | {500: None, 501: "", 502: "never seen words"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    low = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    count, ends = collections.Counter(), 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(low(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    rows = brown.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        c = [count[w] for w in low(texts[r["doc_id"]])] + [ends]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(c), sum(x > 0 for x in c), n)
        assert abs(r["base_score"] - sum(math.log10((x + 1) / (n + v + 1)) for x in c)) < 1e-8 and r["score"] < 0


def trained(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    shards = cut(brown.number_texts(docs, "doc_id", "text", F.lit(True)))
    return shards, *brown.train(shards)


def test_frequent_words_do_not_depend_on_shards(spark, monkeypatch):
    rnd = random.Random(11)
    # the least frequent of the frequent ones are close together and bunched in some of the texts
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(40)] + [f"t{d // 25}x{i}" for i in range(30)], [200 / (i + 2) for i in range(40)] + [1] * 30, k=60)) for d in range(200)]
    count = collections.Counter(w for t in texts for w in t.split())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    for frequent in (20, 60, 10**6):
        monkeypatch.setattr(brown, "FREQUENT", frequent)
        want = [w.encode() for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:frequent]]
        for chars, parts in ((300, 7), (2000, 3), (10**7, 1)):
            monkeypatch.setattr(brown, "SHARD_CHARS", chars)
            shards = cut(brown.number_texts(docs.repartition(parts), "doc_id", "text", F.lit(True)))
            assert brown.frequent_words(shards) == want[:frequent]
    assert brown.frequent_words(shards.limit(0)) == []


def test_counts_beyond_a_cell():
    times = np.array([1, 2**32 - 1, 2**32, 2**34 + 5, 7], np.int64)
    rows = brown._rows(["a", "b"], np.array([3, 5, 9, brown.UNITS + 3, brown.UNITS + 4]), times)
    assert rows["word"].tolist() == ["a", "b"] and rows["n"].tolist() == [int(times[:3].sum()), int(times[3:].sum())]
    held = [np.frombuffer(x, brown._CONTEXT) for x in rows["contexts"]]
    assert [[int(h["n"][h["unit"] == u].sum(dtype=np.int64)) for u in np.unique(h["unit"])] for h in held] == [times[:3].tolist(), times[3:].tolist()]


def test_class_probabilities_sum_to_one(spark):
    _, model, classes = trained(spark, ["a b c a b", "b c d e", None])
    assert np.allclose((10**model.transition).sum(1), 1) and model.ends == 3 and model.tokens == 12
    total = collections.Counter()
    for r in classes.collect():
        total[r["class"]] += (r["n"] + brown.ADD_WORD) / model.denominator[r["class"]]
    for k, p in total.items():
        assert abs(p + brown.ADD_WORD / model.denominator[k] - 1) < 1e-9


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown, "SHARD_CHARS", 3000)
    rnd = random.Random(17)
    texts = [" ".join(rnd.choice(["a b", "c d", "e f"]) + f" w{int(rnd.random() ** 2 * 2500)}" for _ in range(rnd.randint(0, 200))) for _ in range(60)] + [None, "", "Never seen é"]
    shards, model, classes = trained(spark, texts)
    class_of, n = {r["word"]: r["class"] for r in classes.collect()}, {r["word"]: r["n"] for r in classes.collect()}
    count = collections.Counter(w for t in texts for w in (t or "").lower().split())
    assert n == count and len(count) > brown.FREQUENT + 200
    before = lambda w: int(model.context[model.unit(w.encode())])
    pairs = collections.Counter()
    for t in texts:
        path = [None, *(t or "").lower().split(), None]
        pairs.update((brown.CLASSES if a is None else before(a), brown.CLASSES if b is None else class_of[b]) for a, b in zip(path, path[1:]))
    outof, into = collections.Counter(), collections.Counter()
    for (a, b), c in pairs.items():
        outof[a] += c
        into[b] += c
    kinds = collections.Counter(class_of.values()) + collections.Counter([brown.CLASSES])
    found = {r["doc_id"]: r["score"] for r in brown.score_texts(shards, "doc_id", model, classes).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        path = [None, *(t or "").lower().split(), None]
        score = 0.0
        for a, b in zip(path, path[1:]):
            k, c = (brown.CLASSES, len(texts)) if b is None else (class_of[b], count[b])
            h = brown.CLASSES if a is None else before(a)
            score += math.log10((pairs[h, k] + brown.ADD_TRANSITION) / (outof[h] + brown.ADD_TRANSITION * (brown.CLASSES + 1)))
            score += math.log10((c + brown.ADD_WORD) / (into[k] + brown.ADD_WORD * (kinds[k] + 1)))
        assert abs(found[i] - score) < 1e-8


def test_contexts_are_the_same_in_any_shards(spark, monkeypatch):
    texts = [f"the x{i % 7} of y{i % 5} the end" for i in range(80)]
    monkeypatch.setattr(brown, "SHARD_CHARS", 50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = lambda d: sorted((r["word"], r["n"], bytes(r["contexts"])) for r in brown.contexts(cut(brown.number_texts(d, "doc_id", "text", F.lit(True))), [b"the"]).collect())
    few = one(docs.repartition(3))
    monkeypatch.setattr(brown, "SHARD_CHARS", 10**6)
    assert few == one(docs.coalesce(1)) and sum(n for w, n, _ in few if not w) == 80


def test_contexts_travel_in_rows_of_many_words(spark, monkeypatch):
    """A row for each bucket of words, not for each word; tasks that sum their words in several goes give the same."""
    rnd = random.Random(23)
    frequent = [b"the", b"of"]
    texts = [" ".join(rnd.choices(["The", "of", *(f"w{i}" for i in range(3000))], [900, 600] + [1] * 3000, k=200)) for _ in range(60)] + [None, ""]
    want = collections.Counter()
    for t in texts:
        path = [b"", *((t or "").lower().encode().split()), b""]
        want.update((w, brown.END if not a else frequent.index(a) if a in frequent else brown.FREQUENT + brown.group(a)) for a, w in zip(path, path[1:]))
    monkeypatch.setattr(brown, "SHARD_CHARS", 10_000)
    shards = cut(brown.number_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", F.lit(True)))
    for summed in (10, 10**6):
        monkeypatch.setattr(brown, "SUMMED", summed)
        rows = brown.context_blocks(shards, frequent).toPandas()
        assert len(rows) <= brown._buckets(spark) < 100
        found, names = collections.Counter(), []
        for words, sizes, held in brown._blocks(iter([rows])):
            names += words
            for (w, u), n in zip(((w, u) for w, u in zip(np.repeat(np.array(words, object), sizes), held["unit"].tolist())), held["n"].tolist()):
                found[w, u] += n
        assert found == want and len(names) == len(set(names)) > 2500


def test_texts_are_split_at_ascii_white_space(spark, monkeypatch):
    texts = ["", None, " ", "  A\tb\x0b\x0cC\r\n", "x\u2003y\x85z \x1c \x1f\xa0 ", "ÀÉ aZ[", "one", "日本 語\n"] + [chr(i) + "Q" + chr(i) for i in range(1, 128)]
    for chars in (1, 7, 10**6):
        monkeypatch.setattr(brown, "SHARD_CHARS", chars)
        docs = spark.createDataFrame([(None if i == 3 else f"k{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
        shards = brown.number_texts(docs, "doc_id", "text", F.col("doc_id") != "k5").toPandas()
        found = {}
        for r, (_, names, n, ids, training) in zip(shards.itertuples(index=False), brown._shards(iter([shards])), strict=True):
            found |= {k: ([names[i].decode() for i in x], bool(use)) for k, x, use in zip(r.keys, ids, training, strict=True)}
            assert n.tolist() == [sum(int((x == i).sum()) for x, use in zip(ids, training) if use) for i in range(len(names))]
        low = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        assert found == {None if i == 3 else f"k{i}": (low(t), i not in (3, 5)) for i, t in enumerate(texts)}


def test_no_texts(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert brown.query(spark, str(tmp_path)).count() == 0


def test_exchange_raises_the_likelihood():
    rnd = np.random.default_rng(8)
    bigrams = np.zeros((brown.UNITS, brown.UNITS))
    for a, b in itertools.product(range(40), range(40)):
        bigrams[a, b] = rnd.poisson(20 if (a % 4 + 1) % 4 == b % 4 else 0.2)
    xlogx = lambda x: float(np.sum(x * np.log(np.maximum(x, 1))))

    def likelihood(class_of):
        m = np.zeros((5, 5))
        np.add.at(m, (class_of[:, None], class_of[None, :]), bigrams)
        return xlogx(m) - xlogx(m.sum(0)) - xlogx(m.sum(1))

    found = brown.exchange(bigrams, 4)
    assert likelihood(found) > likelihood(np.append(np.arange(brown.UNITS - 1) % 3, 4))
    assert len({tuple(sorted(np.flatnonzero(found[:40] == k) % 4)) for k in range(4)}) >= 3


def test_choice_of_a_class_against_brute_force():
    rnd = np.random.default_rng(4)
    n_words, held = 40, []
    own = rnd.integers(0, 5, n_words)
    for w in range(n_words):
        for h in sorted(rnd.choice(6, rnd.integers(1, 5), replace=False)):
            held.append((w, int(h), int(rnd.integers(1, 90))))
    count = lambda classes: np.bincount([h * (brown.CLASSES + 1) + classes[w] for w, h, _ in held], [n for *_, n in held], (brown.CLASSES + 1) ** 2).reshape(brown.CLASSES + 1, -1)
    value = lambda m: float(brown._xlogx(m).sum() - brown._xlogx(m.sum(0)).sum())
    owner = np.array([w for w, *_ in held])
    found = brown.choose(own, np.searchsorted(owner, np.arange(n_words)), np.array([h for _, h, _ in held]), np.array([n for *_, n in held]), count(own), brown.gains(count(own)))
    for w in range(n_words):
        values = [value(count([*own[:w], k, *own[w + 1 :]])) for k in range(brown.CLASSES)]
        assert values[found[w]] >= max(values) - 1e-6


def test_minimum_cut_against_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 7)
        evidence = [rnd.uniform(-2, 2) for _ in range(n)]
        links = [(a, b, rnd.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        cost = lambda s: sum(abs(v) for i, v in enumerate(evidence) if (v > 0) != s[i]) + sum(w for a, b, w in links if s[a] != s[b])  # noqa: E731, B023
        assert abs(cost(htmlcut.minimum_cut(evidence, links)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><header><h1>Site</h1></header><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text<script>var x="</p>";</script>.<p>Second&nbsp;one &lt;tag&gt;.</p><div class="ad">Buy now!</div><ul><li>Point</ul><form><input>Mail</form></article>
<section id="comments"><p>A reader's long remark about this article that goes on and on and on for quite a while.</p></section><aside>Related</aside><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    w = htmlcut.PRIOR
    assert htmlcut.main_text(PAGE, w) == "Title & more First bold text. Second one <tag>. Point"
    assert htmlcut.main_text(None, w) == "" and htmlcut.main_text("", w) == "" and htmlcut.main_text("<p></p>", w) == ""
    assert htmlcut.main_text("<div><table><tr><td>One cell of it<td>Another</table></div>", w) == "One cell of it Another"
    pages = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "x"), (None, "<p>Text of it, long enough to be one.", "x")], "page_id long, html string, main_text string")
    found = htmlcut.extract(pages, "html", htmlcut.fit(pages)).collect()
    assert len(found) == 4 and found[0]["main_text"] == "Title & more First bold text. Second one <tag>. Point"
    assert htmlcut.fit(pages.limit(0)).tolist() == w.tolist()


def test_url_rules(spark):
    urls = ["http://A.Net/x", "https://m.example.net/en/1", "http://example.com/de/", "http://example.com/de", "http://notexample.com/de/1", "http://x.org/fr/?q#f", "nothing", None, "http://net?x=/", "http://h.net", "x://a.org://fr/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = [tuple(r)[2:] for r in urlfilter.judge(rows, None).orderBy("page_id").select("page_id", "url", "host", "path", "rule", "verdict").collect()]
    assert found == [
        ("a.net", "/x", "net/", "block"), ("m.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("example.com", "/de", None, "allow"),
        ("notexample.com", "/de/1", None, "allow"), ("x.org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "", None, "allow"), ("h.net", "", None, "allow"), ("a.org:", "//fr/", None, "allow"),
    ]


def test_url_trees_on_held_out_urls(spark):
    rnd = random.Random(9)
    name = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    url = lambda bad: f"http://{'free-' if bad else ''}{name()}{'-casino' if bad else ''}.example.com/{'?a=1&b=2&c=3' if bad else 'en/' + name()}"
    labelled = spark.createDataFrame([(url(i % 3 == 0), int(i % 3 == 0)) for i in range(300)] + [(None, 1)], "url string, label int")
    model = urlfilter.train(labelled)
    fresh = spark.createDataFrame([(i, url(i % 2 == 0), 3.0) for i in range(60)] + [(100, None, 1.0)], "page_id long, url string, length double")
    found = urlfilter.judge(fresh, model, rules=()).collect()
    assert len(found) == 61 and sum((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in found if r["page_id"] < 60) >= 57
    assert urlfilter.train(labelled.filter("label = 0")) is None
    assert urlfilter.judge(fresh.limit(0), model).count() == 0


def test_url_filter_learns_from_every_url(spark):
    """Each URL has a suffix of its own: before, 20,000 URLs at most were learned from."""
    urls = spark.range(21_000).select(F.concat(F.lit("https://x.s"), "id", F.lit(".t"), "id", F.lit("/p")).alias("url"), (F.col("id") % 2).alias("label"))
    assert urlfilter.train(urls).suffixes.count() == 21_000


def test_groups_of_words_read_their_endings_alone():
    """A word that ends in ASCII is not decoded; whatever it ends in, its group is that of its last code points."""

    class Undecoded(bytes):
        def decode(self, *_):
            raise AssertionError("decoded")

    words = ["a", "walking", "größe", "straße", "maßab", "日本語", "日abc", "é", "ab\U0001f600", "x́yz"]
    plain = [zlib.crc32(w[-brown.ENDING :].encode()) % brown.GROUPS for w in words]
    assert [brown.group(w.encode()) for w in words] == plain
    assert [brown.group(Undecoded(w.encode())) for w in ("a", "walking", "日abc")] == [plain[i] for i in (0, 1, 6)]
    model = brown.Model(0, 0, 0, {b"walking": (7, 3, 2)}, None, None, None)
    assert model.units([w.encode() for w in words]) == [model.unit(w.encode()) for w in words] == [7 if w == "walking" else brown.FREQUENT + g for w, g in zip(words, plain)]


def test_numbers_of_words_are_small(spark):
    """Shards hold well under the 4 bytes a word of plain numbers, and give the same numbers back."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(3000)], [1 / (i + 2) for i in range(3000)], k=500)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").coalesce(1)
    shards = brown.number_texts(docs, "doc_id", "text", F.lit(True)).collect()
    assert sum(len(r["ids"]) for r in shards) < 2 * 500 * 200
    for shard, found, n, held, _ in brown._shards(iter([pd.DataFrame(shards, columns=shards[0].__fields__)])):
        texts_of = [[found[i].decode() for i in ids] for ids in held]
        assert texts_of == [(t or "").split() for t in [*texts, None]][: len(texts_of)] and len(texts_of) == 201
        assert n.tolist() == [collections.Counter(w for t in texts_of for w in t)[w.decode()] for w in found]
    for kind in (np.int32, np.int64):
        assert brown.unpacked(brown.packed(np.array([], kind)), kind).tolist() == [] and brown.unpacked(brown.packed(np.array([-1, 5, 2**31 - 1], kind)), kind).tolist() == [-1, 5, 2**31 - 1]
