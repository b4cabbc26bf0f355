import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from lectern.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, g int, z int, n int, total int"


def plain(rows):
    """All rows by the definition, from rows(doc_id, text, lang, source)."""
    low = {i: i + 32 for i in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for _, text, lang, source in (r[:4] for r in rows)]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        within = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in within.items() if n >= 3}
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in kept)
        every = sum(counts.values(), Counter())
        price = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for a in counts:
            pairs = [(sum(f(price(counts[a], t), price(counts[b], t)) for t in kept), b) for b in counts if b != a]
            more = [(f(price(counts[a], t), price(every, t)), t) for t in counts[a] if price(counts[a], t) > price(every, t)]
            for part, found in (("pair", pairs), ("term", more)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, a, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < 200]
    return sorted(map(str, out))


def made(rnd):
    rows = []
    for i in range(400):
        lang, source = rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", "c", "", None, "é"])
        words = [f"w{chr(97 + min(25, int(rnd.expovariate(0.2))))}{chr(97 + rnd.randint(0, 25) if source == 'b' else 97)}" for _ in range(rnd.randint(0, 60))]
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in words) + " É🙂x1y", lang, source))
    rows += [(500, None, "en", "empty"), (501, "", "en", "empty"), (502, "alone here", "fr", "a"), (503, None, "fr", "b"), (504, "only one", "it", "a"), (505, "waa " * 200_000 + "wab", "de", "long")]
    return rows + [rows[3], rows[3], (None, "waa wbb", "en", "a")]


def found(spark, rows):
    return sorted(map(str, map(tuple, divergence.divergence(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)).collect())))


def test_against_the_definition(spark, monkeypatch):
    rows = made(random.Random(4))
    assert found(spark, rows) == plain(rows)
    # many blocks, short walks, counts handed on early, texts read in pieces, joins in place of broadcasts
    for name, value in (("PAIRS", 50), ("CHUNK", 3), ("SLAB", 100), ("ROWS", 7), ("SMALL", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_a_term_limit(spark):
    """More than 200 terms of a group, many of equal value."""
    name = lambda i: "t" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, " ".join(name(j) for j in range(400) if (j + i) % 3) + " x" * i, "en", "ab"[i % 2]) for i in range(12)]
    assert found(spark, rows) == plain(rows)


def test_exact_price_of_large_counts(spark):
    from pyspark.sql import functions as F

    n, size, terms = 3 * 10**12, 10**15, 10**9
    got = spark.range(1).select(divergence.price(F.lit(n), F.lit(size), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (size + terms)


def test_quadtree_walk_meets_all_pairs():
    rnd = np.random.default_rng(7)
    for rows_, cols_, cells in ((1, 1, 1), (5, 9, 20), (40, 300, 2000), (300, 3, 400)):
        pairs = np.unique(np.stack([rnd.integers(0, rows_, cells), rnd.integers(0, cols_, cells)], 1), axis=0)
        tree = divergence.Quadtree(pairs[:, 0], pairs[:, 1])
        rows, cols = pairs[tree.order, 0], pairs[tree.order, 1]
        got = [(int(rows[i]), int(rows[j]), int(cols[i])) for a, b in tree.joint_leaves(7) for i, j in zip(a, b, strict=True)]
        assert all(cols[i] == cols[j] for a, b in tree.joint_leaves() for i, j in zip(a, b, strict=True))
        by = pd.DataFrame(pairs, columns=["r", "c"])
        both = by.merge(by, on="c").query("r_x < r_y")
        assert sorted(got) == sorted(map(tuple, both[["r_x", "r_y", "c"]].to_numpy().tolist()))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = base.execute(divergence.oracle())
    columns = [d[0] for d in cursor.description]
    assert sorted(map(str, map(tuple, divergence.query(spark, sf).select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))
