"""Sharding by a permutation-filled lookup table (operator 2).

Every shard has its own permutation of the slots of a prime-sized table, given by an
offset and a skip. The shards take turns; at its turn a shard claims the first slot of
its permutation that is still free, until all slots are taken. A row goes to the shard
that owns slot hash(key) mod size. Shards own equally many slots, give or take one, and
when a shard comes or goes few slots change their owner.

The table depends on the shard names and its size alone, never on the data; with
``table_size`` rows it is safe to broadcast at any input size, and the rows to be placed
are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import hash60, table

TABLE_SIZE = 2039
SHARDS = tuple(f"shard-{i:02d}" for i in range(20))


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """(slot int, shard string), one row for each slot. table_size: a prime, about a hundred times the number of shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards: one or more distinct names")
    if table_size < len(shards) or any(table_size % d == 0 for d in range(2, int(table_size**0.5) + 1)):
        raise ValueError("table_size: a prime, at least as many as the shards")
    size = F.lit(table_size).cast("long")
    names = spark.range(len(shards)).select(F.col("id").cast("int").alias("turn"), F.array(*map(F.lit, shards))[F.col("id").cast("int")].alias("shard"))
    prefs = (
        names.withColumn("offset", hash60(F.concat(F.lit("offset|"), "shard")) % size)
        .withColumn("skip", hash60(F.concat(F.lit("skip|"), "shard")) % (size - 1) + 1)
        # the inverse of skip mod size turns a slot into its place in the shard's permutation
        .withColumn("inverse", F.filter(F.sequence(F.lit(1), F.lit(table_size - 1)), lambda x: (x * F.col("skip")) % size == 1)[0].cast("long"))
    )
    fold = F.aggregate(
        F.sequence(F.lit(0), F.lit(table_size - 1)),
        F.struct(
            F.sequence(F.lit(0), F.lit(table_size - 1)).alias("free"),
            F.expr("cast(array() as array<struct<slot:int,turn:int>>)").alias("owned"),
        ),
        lambda state, t: _claim(state, F.col("prefs")[(t % len(shards)).cast("int")], size),
        lambda state: state["owned"],
    )
    filled = (
        prefs.agg(F.sort_array(F.collect_list(F.struct("turn", "offset", "skip", "inverse", "shard"))).alias("prefs"))
        .select(F.explode(fold).alias("claim"))
        .select("claim.slot", "claim.turn")
    )
    return filled.join(F.broadcast(names), "turn").select("slot", "shard")


def _claim(state, pref, size):
    """One turn: the free slot that comes first in the shard's permutation changes hands."""
    place = lambda slot: ((slot - pref["offset"] + size) * pref["inverse"]) % size
    slot = F.array_min(F.transform(state["free"], lambda s: F.struct(place(s).alias("place"), s.alias("slot"))))["slot"]
    return F.transform(F.array(slot), lambda s: F.struct(
        F.array_remove(state["free"], s).alias("free"),
        F.concat(state["owned"], F.array(F.struct(s.alias("slot"), pref["turn"].alias("turn")))).alias("owned"),
    ))[0]


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """df with the columns ``slot`` and ``shard``.

    Equal keys meet in one shard; a null key counts as the empty string. Columns of df named slot or
    shard are replaced, the key too if it is one of them. An empty df gives an empty result; repeated rows each keep their place.
    """
    slot = (hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))) % F.lit(table_size)).cast("int")
    placed = df.withColumn("__slot", slot).drop("slot", "shard").withColumnRenamed("__slot", "slot")
    return placed.join(F.broadcast(lookup_table(df.sparkSession, shards, table_size)), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def oracle() -> str:
    h = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    m = TABLE_SIZE
    return f"""
WITH RECURSIVE names AS (
  SELECT i::INT AS turn, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range({len(SHARDS)}) r(i)
), prefs AS (
  SELECT turn, shard, {h("'offset|' || shard")} % {m} AS offs, {h("'skip|' || shard")} % {m - 1} + 1 AS skip FROM names
), places AS (
  SELECT turn, list((offs + j * skip) % {m} ORDER BY j) AS slots FROM prefs, range({m}) g(j) GROUP BY turn
), fill AS (
  SELECT 0 AS t, NULL::BIGINT AS slot, list_transform(range({m}), lambda x: true) AS free
  UNION ALL
  SELECT t + 1, pick, list_transform(free, lambda x, i: x AND i <> pick + 1)
  FROM (SELECT f.t, f.free, list_filter(p.slots, lambda x: f.free[x + 1])[1] AS pick
        FROM fill f JOIN places p ON p.turn = f.t % {len(SHARDS)} WHERE f.t < {m})
), lookup AS (
  SELECT slot, (t - 1) % {len(SHARDS)} AS turn FROM fill WHERE slot IS NOT NULL
)
SELECT doc_id, lookup.slot::INT AS slot, names.shard
FROM (SELECT doc_id, {h("coalesce(doc_id::VARCHAR, '')")} % {m} AS slot FROM documents) d
JOIN lookup USING (slot) JOIN names USING (turn)"""
