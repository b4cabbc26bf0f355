"""Streams: token deltas folded to texts, debounced updates, newest-wins writes and entries that expire.

Each function takes a batch or a streaming DataFrame where its semantics allow it; give streams a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELTA = "struct<choices:array<struct<delta:struct<content:string>>>,type:string,delta:string,text:string>"
#: Seconds of life that an entry must have left to be used.
MINIMUM_TTL = 120


def delta_of(line: Column) -> Column:
    """The JSON of a server-sent line; null for other lines, the end mark and what doesn't parse."""
    body = F.trim(F.regexp_extract(line, r"^data:\s*(.*)$", 1))
    return F.from_json(F.when((body != "") & (body != "[DONE]"), body), DELTA)


def fold_chat(rows: DataFrame, stream: str, order: str, line: str) -> DataFrame:
    """(stream, text): the contents of a stream's deltas in order, trimmed."""
    found = rows.withColumn("d", delta_of(F.col(line))).withColumn("piece", F.get("d.choices", F.lit(0))["delta"]["content"])
    pieces = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct(F.col(order).alias("n"), "piece"))))
    return found.groupBy(stream).agg(F.trim(F.array_join(F.transform(pieces, lambda p: p["piece"]), "")).alias("text"))


def fold_responses(rows: DataFrame, stream: str, order: str, line: str) -> DataFrame:
    """(stream, text, failed): a stream's done text, else its deltas in order; failed if an event says so."""
    found = rows.withColumn("d", delta_of(F.col(line)))
    of = lambda kind, value: F.sort_array(F.collect_list(F.when(F.col("d.type").endswith(kind), F.struct(F.col(order).alias("n"), F.coalesce(value, F.lit("")).alias("v")))))
    joined = F.array_join(F.transform(of("delta", F.col("d.delta")), lambda p: p["v"]), "")
    done = F.get(F.transform(of("done", F.col("d.text")), lambda p: p["v"]), F.lit(0))
    return found.groupBy(stream).agg(F.trim(F.coalesce(done, joined)).alias("text"), F.coalesce(F.max(F.col("d.type").endswith("failed")), F.lit(False)).alias("failed"))


def debounce(rows: DataFrame, key: str, at: str, gap: str, value: str) -> DataFrame:
    """(key, start, end, n, value): updates less than ``gap`` apart are one, with the value of the last."""
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max_by(value, at).alias(value)).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", value)


def newest(rows: DataFrame, key: str, sequence: str, value: str) -> DataFrame:
    """(key, value): what the request with the highest number wrote."""
    return rows.groupBy(key).agg(F.max_by(value, sequence).alias(value))


def usable(expires: Column, now: Column, minimum: int = MINIMUM_TTL) -> Column:
    """Whether an entry lives long enough; one that never expires does."""
    return expires.isNull() | (expires - now > minimum)
