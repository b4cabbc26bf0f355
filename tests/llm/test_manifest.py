import hashlib
import zlib

import duckdb
import pytest

from lectern.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, pos int, hash string, root int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """The levels of a tree, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def plain_way(levels, i):
    out = []
    for now in levels[:-1]:
        out.append((i % 2, now[i ^ 1] if i ^ 1 < len(now) else None))
        i //= 2
    return out


def plain_rows(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified, from rows(doc_id, text, lang, source, n_chars)."""
    trees = {}
    for doc_id, text, lang, source, n in (r[:5] for r in rows):
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        trees.setdefault(lang, []).append((doc_id, plain_leaf(doc_id, source, lang, n, text), plain_leaf(doc_id, source, lang, n + changed if n is not None else None, text)))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    levels = {k: plain_tree([r[1] for r in trees[k]]) for k in names}
    top = plain_tree([levels[k][-1][0] for k in names])
    out = []
    for t, k in enumerate(names):
        for i, (doc_id, leaf, now) in enumerate(trees[k]):
            way = plain_way(levels[k], i) + plain_way(top, t)
            for side, sibling in way:
                now = H(now) if sibling is None else H(sibling, now) if side else H(now, sibling)
            root = top[-1][0]
            out.append((doc_id, leaf, levels[k][-1][0], root, H(*(s or "" for _, s in way)), now, now == root))
    return sorted(map(str, out))


def tables(spark, path, rows):
    spark.createDataFrame([(*r, 1, 2, "clash", 3) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


ROWS = [(i, f"text {i} é", ("en", "de", None, "")[i % 13 % 4], ("a", None)[i % 2], i % 50 or None) for i in range(300)]
ROWS += [(None, "no number", "en", "a", 5), (None, None, None, None, None), (7, "text 7 é", "fr", None, 7), (7, "another", "fr", "a", 7), (7, "another", "fr", "a", 7), (900, "x" * 300_000, "ぁ", "a", 300_000), (901, "", "😀", "", 0)]


@pytest.mark.parametrize("levels,small", [(10, 20_000), (2, 0)])
def test_against_plain_trees(spark, tmp_path, monkeypatch, levels, small):
    """Also with many layers, and with joins in place of broadcasts."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "SMALL", small)
    found = [tuple(r) for r in manifest.query(spark, tables(spark, tmp_path / "t", ROWS)).collect()]
    assert sorted(map(str, found)) == plain_rows(ROWS)
    tampered = [r for r in found if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0]
    assert tampered and not any(r[-1] for r in tampered if dict((x[0], x[4]) for x in ROWS)[r[0]] is not None) and sum(r[-1] for r in found) > 200


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_few_rows(spark, tmp_path, n):
    rows = [(i, f"t{i}", "en", "a", 2) for i in range(n)]
    found = manifest.query(spark, tables(spark, tmp_path / "t", rows))
    assert sorted(map(str, map(tuple, found.collect()))) == (plain_rows(rows) if n else [])


def test_equal_rows(spark, tmp_path):
    rows = [(1, "same", "en", "a", 4)] * 700 + [(2, "other", "en", "a", 5)]
    assert sorted(map(str, map(tuple, manifest.query(spark, tables(spark, tmp_path / "t", rows)).collect()))) == plain_rows(rows)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = base.execute(manifest.oracle())
    columns = [d[0] for d in cursor.description]
    assert sorted(map(str, map(tuple, manifest.query(spark, sf).select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))
