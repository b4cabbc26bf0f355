import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints as fp
from lectern.llm import mixing, sharding

DOCS = "doc_id long, text string, source string"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fingerprint_is_a_multiset_hash(spark):
    f = lambda t: fp.fingerprint(F.lit(t))
    row = one(spark, f("a b.\nc d. e!").alias("ab"), f("c d. e!\na b.").alias("ba"), f("a b.").alias("a"), f("c d. e!").alias("b"), f("a b.\na b.").alias("aa"), f("").alias("none"))
    assert row["ab"] == row["ba"] and row["aa"] != row["a"] and set(row["none"]) == {0}
    sums = one(spark, fp.add(f("a b."), f("c d. e!")).alias("sum"), fp.subtract(f("a b.\nc d. e!"), f("c d. e!")).alias("rest"))
    assert sums["sum"] == row["ab"] and sums["rest"] == row["a"]


def test_likeness(spark):
    lines = [f"This is sentence number {i} of it." for i in range(60)]
    text = lambda a, b: F.lit("\n".join(lines[a:b]))
    near = lambda a, b: fp.likeness(fp.signs(fp.fingerprint(a)), fp.signs(fp.fingerprint(b)))
    same, half, none, empty = one(spark, near(text(0, 40), text(0, 40)), near(text(0, 40), text(20, 60)), near(text(0, 30), text(30, 60)), near(F.lit(""), F.lit(None).cast("string")))
    assert same == 1.0 and empty == 1.0 and abs(half - 1 / 3) < 0.15 and none < 0.15


@pytest.mark.parametrize("range_rows", [2, 2000])
def test_fingerprint_query_against_brute_force(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", range_rows)
    texts = {5: "Héllo wörld.\nTwo", 1: None, 9: "", 1000: "x" * 1001, 7: "😀 astral. Text here", -3: "a"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids = sorted(texts)
    rows = fp.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(ids)
    for r in rows:
        t, n = texts[r["doc_id"]] or "", texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1.0) >= (edited == t)


def test_fingerprint_query_edge_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert fp.query(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "odd/documents.parquet"))
    rows = fp.query(spark, str(tmp_path / "odd")).collect()
    assert len(rows) == 4 and len({r["fingerprint"] for r in rows if r["n_chars"]}) == 1


def maglev(shards, size):
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    prefs = {s: (h("offset|" + s) % size, h("skip|" + s) % (size - 1) + 1) for s in shards}
    owner, at = {}, dict.fromkeys(shards, 0)
    while len(owner) < size:
        for s in shards:
            if len(owner) == size:
                break
            while (slot := (prefs[s][0] + at[s] * prefs[s][1]) % size) in owner:
                at[s] += 1
            owner[slot] = s
    return owner


def test_lookup_table_against_the_plain_method(spark):
    shards = [f"s{i}" for i in range(7)]
    found = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, shards, 101).collect()}
    assert found == maglev(shards, 101)
    sizes = Counter(found.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = maglev(shards[:-1], 101)
    assert sum(found[s] != fewer[s] for s in found if found[s] != "s6") < 40


def test_sharding_edges(spark):
    df = spark.createDataFrame([(1, "x", 5), (None, None, 6), (1, "x", 5)], "doc_id long, shard string, slot int")
    rows = sharding.assign_shards(df, "doc_id", ["a", "b"], 11).collect()
    assert len(rows) == 3 and {r["shard"] for r in rows} <= {"a", "b"} and len({r["slot"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.assign_shards(df.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, ["a"], 12)


def test_targets_stop_at_twice_a_source(spark):
    docs = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, size long")
    rows = {r["source"]: r["target"] for r in mixing.targets(docs).collect()}
    assert rows["a"] == 20 and abs(rows["b"] / rows[None] - 0.5) < 1e-9 and abs(sum(rows.values()) - 3015) < 1e-6


def test_mix_takes_its_targets_and_no_document_over_twice(spark):
    docs = spark.createDataFrame([(i, ("a", "b", None)[i % 3] if i % 5 else "a", 40 + i % 700) for i in range(400)], "doc_id long, source string, size long")
    packed, held = mixing.mix(docs, ["doc_id"])
    taken = held.groupBy("source_index", "start").agg(F.sum("words").alias("words"))
    rows = packed.join(taken, ["source_index", "start"], "left").collect()
    assert len(rows) == 400 and all((r["words"] or 0) <= 2 * r["size"] for r in rows)
    by, target = Counter(), {}
    for r in rows:
        by[r["source_index"]] += r["words"] or 0
        target[r["source_index"]] = r["target"]
    assert all(abs(by[s] - t) <= 3 * mixing.BLOCK_WORDS for s, t in target.items())
    # whole blocks of a pass are permuted: each at most once
    assert held.groupBy("source_index", "pass", "start", "low").count().filter("count > 1").count() == 0


def test_mix_documents_keeps_columns_and_words(spark):
    rows = [(i, f"{'w%d ' % i * (i % 50)}end\nline", "s", i, 7) for i in range(60)] + [(100, None, None, 1, 1), (101, "  ", "s", 1, 1), (5, "w5 " * 5 + "end\nline", "s", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, start long")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(set(r["text"].split()) <= {f"w{r['doc_id']}", "end", "line"} and r["text"].split() for r in found)
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix_documents(docs.repartition(7)).collect()))
