import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lectern.llm import decontam, simhash
from lectern.llm.components import components


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def plain_fingerprint(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(values):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(values, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = sorted((root(i), root(int(j))))
            parent[y] = x
    return [root(i) for i in range(len(values))]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprints():
    for t in ["", None, "one", "One two", "a b c d e a b c", "Über  straße\tund\x0bmehr " * 30, "x" * 5000]:
        assert simhash.fingerprint(t) == signed(plain_fingerprint(t))


def test_links_join_what_brute_force_joins(spark):
    rnd = random.Random(1)
    values = set()
    for c in range(30):
        x = rnd.getrandbits(64)
        for _ in range(50):
            y = x
            for b in rnd.sample(range(64 if c % 2 else 12), rnd.randint(0, 5)):
                y ^= 1 << b
            values.add(y)
            if rnd.random() < 0.3:
                x = y
    values = sorted(values)
    links = simhash.link(spark.createDataFrame([(signed(v),) for v in values], "fp long")).collect()
    assert all(bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= 3 for r in links)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links)).collect()}
    by = {}
    for v, c in zip(values, plain_classes(values), strict=True):
        by.setdefault(c, set()).add(found.get(signed(v), signed(v)))
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 40)] + [(7, 7), (50, 49), (49, 50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(1, 40)} == {1} and found[50] == 49
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_and_keep_one(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(4, long, "a"), (2, long, "b"), (9, long + " ", "c"), (7, "quite another text altogether", "d"), (8, None, "e"), (1, "", "f"), (1, "", "f"), (None, "something else in here", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = {(r["doc_id"], r["component"]) for r in simhash.near_duplicates(docs, "doc_id", "text").collect()}
    assert found == {(4, 2), (2, 2), (9, 2), (7, 7), (8, 1), (1, 1), (None, None)}
    kept = simhash.keep_one(docs, "doc_id", "text")
    assert kept.columns == docs.columns and sorted(r["fp"] for r in kept.collect()) == ["b", "d", "f", "g"]
    assert simhash.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_hits(text, items, n=10):
    w = WORDS.findall(lower(text))
    hit, found = set(), set()
    for name, t in items:
        iw = WORDS.findall(lower(t))
        for o in range(max(1, len(iw) - n + 1) if iw else 0):
            win = iw[o : o + n]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_matches_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["a", "bb", "Été", "x1", "of", "THE"])
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(str(i), text(rnd.choice([2, 9, 10, 14, 25]))) for i in range(12)] + [("empty", "..."), ("null", None), ("3", text(12))]
    docs = [(i, text(rnd.randint(0, 400)) + rnd.choice(["", " " + (items[i % 12][1] or "")]) + " " + text(5)) for i in range(60)] + [(100, None), (101, ""), (7, "a")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, matches int")
    for block, shard in ((200_000, 2_000_000), (60, 900)):
        monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
        monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
        found = decontam.find_matches(frame, "text", spark.createDataFrame(items, "item_id string, text string")).withColumn("n_hit", decontam.covered(F.col("matches"))).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], sorted({m["item_id"] for m in r["matches"]})) for r in found) == sorted((i, *plain_hits(t, items)) for i, t in docs)


def test_longest_matches_have_their_places(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z"
    frame = decontam.find_matches(spark.createDataFrame([(1, doc)], "doc_id long, text string"), "text", spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [tuple(m) for m in frame.first()["matches"]] == [("1", 2, 5, 20)]


def test_decontaminate_keeps_clean_rows(spark):
    docs = spark.createDataFrame([(1, "nothing to see", "k"), (2, "one two three four five six seven eight nine ten eleven", "k"), (3, None, "k")], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id long, text string")
    out = decontam.decontaminate(docs, items)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    assert decontam.decontaminate(docs, items.limit(0)).count() == 3 and decontam.decontaminate(docs.limit(0), items).count() == 0


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "A b"), (2, "b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    r = decontam.query(spark, str(tmp_path)).first()
    assert (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (2, 2, hashlib.sha256(b"1,2").hexdigest(), True)
