"""Stateful streams equal their batch functions, whatever the order of rows, also when a query is stopped and started again."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.streaming import events, stateful

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def played(spark, tmp_path, files, schema, transform, name, mode="append", restart=True):
    """The rows that a stream gives for files that come one after another; with restart the query is stopped half way and goes on from its checkpoint."""
    stateful.prepare(spark)
    source, out, mark = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "mark"))
    half = len(files) // 2 if restart else len(files)
    for part in (files[:half], files[half:]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if not part:
            continue
        stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        query = stream.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True)
        query = query.option("path", out).start() if mode == "append" else query.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start()
        query.awaitTermination()
    return spark.read.parquet(out)


def dealt(rnd, rows, n, spread):
    """Rows in n files, each not far from its time, some of them in two files."""
    rows = sorted(rows, key=lambda r: (r[-1] + dt.timedelta(seconds=rnd.uniform(-spread, spread))))
    size = -(-len(rows) // n)
    files = [rows[i : i + size] for i in range(0, len(rows), size)]
    for i in range(1, len(files)):
        files[i] = files[i] + rnd.sample(files[i - 1], min(3, len(files[i - 1])))
    return files


def delta(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def test_folds_equal_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = []
    for s in range(6):
        lines = [delta(f"{s}.{i} ") if i % 4 else rnd.choice(["", ": ping", "data: {bad", "data: [1]", "data: [DONE]" if i > 12 else "data:"]) for i in range(16)]
        rows += [(f"c{s}", i, line, at(10 * s + i)) for i, line in enumerate(lines)]
    for s in range(4):
        lines = [json.dumps({"type": "response.output_text.delta", "delta": f"{i}-"}) for i in range(8)]
        lines += [json.dumps({"type": "response.output_text.done", "text": "the whole"})] if s % 2 else [json.dumps({"type": "response.failed"})] if s == 2 else []
        rows += [(f"r{s}", i, f"data: {x}", at(10 * s + i)) for i, x in enumerate(lines)]
    files = dealt(rnd, rows, 5, 3) + [[("end", 0, "", at(4000))], [("end", 1, "", at(4001))]]
    schema = "stream string, n long, line string, at timestamp"
    found = played(spark, tmp_path, files, schema, lambda s: stateful.fold_stream(s, "1 minute"), "fold")
    got = {r.stream: (r.text, r.failed) for r in found.collect() if r.stream != "end"}
    table = spark.createDataFrame(rows, schema)
    chat = events.fold_chat(table.filter("stream like 'c%'"), "stream", "n", "line").collect()
    other = events.fold_responses(table.filter("stream like 'r%'"), "stream", "n", "line").collect()
    assert got == {r.stream: (r.text, False) for r in chat} | {r.stream: (r.text, r.failed) for r in other} and len(got) == 10


def test_debounce_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k, f"{k}{i}" if i % 9 else None, i % 17 == 16, at(i * 40 + rnd.choice([0, 5, 60, 200]))) for k in "abc" for i in range(60)]
    rows += [(None, "of no key", False, at(100))]
    files = dealt(rnd, rows, 6, 0) + [[("end", "x", False, at(90_000))], [("end", "y", False, at(90_001))]]
    schema = "key string, value string, final boolean, at timestamp"
    found = played(spark, tmp_path, files, schema, lambda s: stateful.debounce_stream(s, 90_000, "5 minutes"), "debounce")
    plain = stateful.debounce_final(spark.createDataFrame(rows, schema), 90_000)
    key = lambda r: (str(r["key"]), r["at"], str(r["value"]))
    assert sorted(map(key, found.filter("key is null or key <> 'end'").collect())) == sorted(map(key, plain.collect())) and plain.count() > 20


def test_a_final_update_does_not_wait(spark, tmp_path):
    schema = "key string, value string, final boolean, at timestamp"
    files = [[("a", "one", False, at(0))], [("a", "two", True, at(1))], [("a", "one again", False, at(0.5))], [("a", "three", False, at(2))]]
    found = played(spark, tmp_path, files, schema, lambda s: stateful.debounce_stream(s, 120_000, "1 hour"), "final", restart=False).collect()
    assert [(r.value, r.at) for r in found] == [("two", at(1))]


def test_newest_and_expiry_equal_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.choice([None, *range(30)]), f"v{i}", None if i % 11 == 0 else at(i * 30 + rnd.choice([60, 150, 400])), at(i * 30)) for i in range(80)]
    schema = "key string, n long, value string, expires timestamp, at timestamp"
    files = dealt(rnd, rows, 4, 20)
    newest = played(spark, tmp_path, files, schema, lambda s: stateful.newest_stream(s, "1 hour"), "newest", mode="update")
    last = {r.key: (r.n, r.value) for r in sorted(newest.collect(), key=lambda r: r.batch)}
    best = {}
    for k, n, v, *_ in rows:
        if n is not None:
            best[k] = max(best.get(k, (-1, "")), (n, v))
    assert last == best
    numbers = [r.n for r in sorted(newest.filter("key = 'a'").collect(), key=lambda r: r.batch)]
    assert numbers == sorted(numbers)
    ends = [("end", 0, "x", at(90_000), at(80_000)), ("end", 0, "y", at(90_001), at(80_001))]
    gone = played(spark, tmp_path, [*files, ends[:1], ends[1:]], schema, lambda s: stateful.expire_stream(s, "5 minutes"), "expire")
    plain = stateful.expire_table(spark.createDataFrame(rows, schema).select("key", "value", "expires", "at"))
    assert sorted(map(tuple, gone.filter("key <> 'end'").collect())) == sorted(map(tuple, plain.select(*gone.columns).collect())) and plain.filter("replaced").count() > 5


@pytest.mark.parametrize("lines", [[], [None, "x", "data: null", "data: 3", 'data: {"choices": 1}', 'data: {"choices": [{"delta": {"content": null}}]}', 'data: {"choices": []}']])
def test_lines_that_say_nothing(lines):
    assert stateful.fold_lines(lines) == ("", False, False)
