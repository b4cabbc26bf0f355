"""The index store and the memo: runs that are doubled or killed, records that can't be read, older roots, skewed keys."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import batches, index_store, tables

DOCS = "doc_id long, text string"


def docs(spark, *rows):
    return tables.build_documents(spark.createDataFrame([*rows], DOCS))


def copies(frame):
    return sorted((r.doc_id, r["count"]) for r in frame.groupBy("doc_id").count().collect())


def test_repeated_and_killed_runs_leave_one_copy(spark, tmp_path):
    path = str(tmp_path / "index")
    some = docs(spark, (1, "Some text here. And more."), (2, "Other text. " * 3), (1, "Some text here. And more."), (None, "of no document"))
    first = copies(index_store.ensure_index(spark, some, path))
    assert [d for d, _ in first] == [1, 2] and copies(index_store.ensure_index(spark, some, path)) == first
    # a run that wrote its batch, and whose caller didn't hear of it, runs again as if nothing was there
    name = batches.batch_name(some.filter("doc_id is not null").dropDuplicates(["doc_id", "content_hash"]).select("doc_id", "content_hash"))
    for _ in range(2):
        batches.write_batch(tables.build_index(some.filter("doc_id is not null")), path, name, ["chunk_policy"])
    assert copies(spark.read.parquet(path)) == first
    # two runs at once, whose documents overlap
    batches.write_batch(tables.build_index(docs(spark, (2, "Other text. " * 3), (3, "A third one."))), path, "0-another", ["chunk_policy"])
    assert copies(index_store.load_index(spark, [path])) == [*first, (3, 2)]
    assert copies(index_store.ensure_index(spark, docs(spark, (1, "A new version of it.")), path)) == [(1, 2)]
    assert len({r.content_hash for r in index_store.load_index(spark, [path]).filter("doc_id = 1").select("content_hash").collect()}) == 2


def test_an_older_root_is_read_where_the_new_one_lacks_it(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    one, two = docs(spark, (1, "Some text here.")), docs(spark, (1, "Some text here."), (2, "Other text."))
    index_store.ensure_index(spark, one, old)
    assert copies(index_store.ensure_index(spark, two, new, older=[old])) == [(1, 2), (2, 2)]
    assert copies(spark.read.parquet(new)) == [(2, 2)] and copies(index_store.load_index(spark, [new, old])) == [(1, 2), (2, 2)]
    assert index_store.load_index(spark, [str(tmp_path / "none")]) is None
    assert index_store.ensure_index(spark, two.limit(0), str(tmp_path / "none")).collect() == []


def test_records_there_and_back_and_what_can_not_be_read(spark, tmp_path):
    index = tables.build_index(docs(spark, (1, "Abstract\nSome text here.\n\nIntroduction\nMore of it."), (2, 'Other "text" & more.')))
    records = index_store.to_records(index)
    assert sorted(r.name for r in records.collect()) == sorted({f"{r.doc_id}-{r.content_hash[:16]}.json" for r in index.collect()})
    back, bad = index_store.from_records(records.union(records))
    columns = [c for c in index.columns if c != "doc_id"]
    assert bad.count() == 0 and sorted(map(str, back.select(F.col("doc_id").cast("long"), *columns).collect())) == sorted(map(str, index.select("doc_id", *columns).collect()))
    good = json.loads(records.filter("name like '1-%'").first().record)
    name = f"1-{good['pdf_hash'][:16]}.json"
    odd = {"no JSON": ["{", "", None, "[1"], "version": [json.dumps({**good, "version": 2}), "{}"], "no chunks": [json.dumps({k: v for k, v in good.items() if k != "chunks"})], "name": [json.dumps({**good, "paper_id": "9"}), json.dumps({**good, "pdf_hash": None})]}
    rows = [(name, r) for rs in odd.values() for r in rs] + [(name, json.dumps(good)), (None, json.dumps(good))]
    back, bad = index_store.from_records(spark.createDataFrame(rows, "name string, record string"))
    assert sorted(r.reason for r in bad.collect()) == sorted(k for k, rs in odd.items() for _ in rs) and back.count() == len(good["chunks"])
    new, old = tmp_path / "new", tmp_path / "old"
    for folder, lines in ((new, ["{broken", json.dumps({**good, "embed_model": "new"})]), (old, [json.dumps(good), json.dumps({**good, "paper_id": "7"})])):
        folder.mkdir()
        (folder / "a.json").write_text("\n".join(lines))
    kept, bad = index_store.read_records(spark, [str(new), str(old)])
    assert {(r.name.split("-")[0], json.loads(r.record)["embed_model"]) for r in kept.collect()} == {("1", "new"), ("7", "")} and [(r.root, r.record) for r in bad.collect()] == [(str(new), "{broken")]
    assert [r.label for r in index_store.labels(index.filter("doc_id = 2")).collect()] == ["인덱싱 됨 · BM25 · 1 chunks"] and index_store.latest(index).count() == 2


def test_memo_runs_once_for_each_new_text(spark, tmp_path):
    path, calls = str(tmp_path / "memo"), spark.sparkContext.accumulator(0)

    def costly(rows):
        def run(frames):
            for f in frames:
                calls.add(len(f))
                yield f[["key"]].assign(value=[t.upper() for t in f["text"]])

        return rows.mapInPandas(run, "key string, value string")

    hot = [(i, "the same text") for i in range(500)]
    rows = spark.createDataFrame([*hot, (900, "a"), (901, None), (902, ""), (903, "a")], "id long, text string").repartition(4)
    plain = lambda got: all((r.value is None) if r.text is None else r.value == r.text.upper() for r in got)
    got = batches.memoized(rows, "text", path, costly).collect()
    assert len(got) == 504 and plain(got) and calls.value == 3
    got = batches.memoized(rows.union(spark.createDataFrame([(1, "b"), (2, "b")], "id long, text string")), "text", path, costly).collect()
    assert len(got) == 506 and plain(got) and calls.value == 4
    none = batches.memoized(rows.limit(0), "text", str(tmp_path / "other"), costly)
    assert none.collect() == [] and none.columns == ["id", "text", "value"] and calls.value == 4
    with pytest.raises(Exception, match="nothing"):
        batches.memoized(rows, "text", str(tmp_path / "third"), lambda rows: rows.select("key", F.raise_error(F.lit("nothing")).cast("string").alias("value"))).collect()
    assert len(batches.memoized(rows, "text", str(tmp_path / "third"), costly).collect()) == 504
