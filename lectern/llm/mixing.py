"""Mixing sources to target weights (operator 6).

The words of a source, its documents one after another in a pseudorandom order, are packed
into blocks of a fixed length: ``BLOCK_WORDS``, or less for a source of under ``LEAST_BLOCKS`` such
blocks, so that a small source can come near its target too. A source fills as many slots as its
target takes in blocks; every slot draws its output shard, so the counts of the sources in a shard are
multinomial draws by the target weights, given the totals that the targets fix. The slots of a source are numbered
over all shards; a slot is mapped to a block by a pseudorandom permutation of the source's
block indexes, a new one for each pass over the source, and slots and blocks are joined by
index. No pass repeats a block, and a source is passed over at most ``MAX_PASSES`` times, so no
document is taken more than that many times.

Everything is drawn by hashes of names and indexes: reruns agree, whatever the cluster.
Rows that are shuffled are indexes and sizes, never texts; a hot source is spread over its
hash buckets (for the packing) and its blocks (for the join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import hash60, table, word_count

BLOCK_WORDS = 256
#: Blocks of a source from which they have full length.
LEAST_BLOCKS = 128
#: Slots of an output shard, on average.
SLOTS_PER_SHARD = 65536
#: Parts into which a source is split for packing.
BUCKETS = 1024
#: The weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words.
SHARE = 1.5
MAX_PASSES = 2
#: Slots that one task lays out at a time.
SPAN = 65536
#: Primes for the multiplier of a permutation of block indexes.
PRIMES = (2147483629, 2147483587, 2147483579, 2147483563)


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_index, source_size, weight, target, block_words, blocks): one row for each source, from docs(source, size).

    Sources are in the order of their code points, null last. A target stops at MAX_PASSES times the
    source's size; what it leaves is shared by the others by weight until none is above.
    """
    w = F.array(*[F.lit(x) for x in weights])
    every = W.partitionBy()
    by_source = W.orderBy(F.col("source").isNull(), "source")
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "source_index")
    before, onward = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing)
    return (
        docs.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_index", F.row_number().over(by_source) - 1)
        .withColumn("weight", w[F.col("source_index") % len(weights)])
        .withColumn("cap", F.lit(MAX_PASSES) * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
        .withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
        .select("source", "source_index", "source_size", "weight", "target", "block_words", "blocks")
    )


def draw(sources: DataFrame, seed: str = "mix") -> DataFrame:
    """(source_index, blocks, number, shard): the slots of each source, numbered, and the output shard that each draws.

    Whole passes over the source hold whole blocks only, so the slots are those of the whole passes in the target and as many
    blocks as the rest of it takes, to the nearest.
    """
    passes = F.floor(F.col("target") / F.col("source_size"))
    part = F.round((F.col("target") - passes * F.col("source_size")) / F.col("block_words"))
    counted = sources.filter("source_size > 0").withColumn("slots", F.least(passes * F.col("blocks") + part, F.col("blocks") * MAX_PASSES).cast("long"))
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(W.partitionBy()) / SLOTS_PER_SHARD)).cast("long")
    spans = (
        counted.withColumn("shards", shards)
        .filter("slots > 0")
        .withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SPAN).cast("long"))))
        .repartition("source_index", "span")  # else all slots of a source come from one task
    )
    upto = F.least(F.col("slots"), (F.col("span") + 1) * SPAN) - 1
    return (
        spans.withColumn("number", F.explode(F.sequence(F.col("span") * SPAN, upto)))
        .withColumn("shard", hash60(F.concat_ws("|", F.lit(seed), F.lit("shard"), "source_index", "number")) % F.col("shards"))
        .select("source_index", "blocks", "number", "shard")
    )


def counts(sources: DataFrame, seed: str = "mix") -> DataFrame:
    """(shard, source_index, slots): how many slots of each output shard each source has drawn."""
    return draw(sources, seed).groupBy("shard", "source_index").agg(F.count("*").alias("slots"))


def slots(drawn: DataFrame, seed: str = "mix") -> DataFrame:
    """(source_index, shard, pass, block): a row for each slot of the mix, mapped to a block of its source."""
    spread = drawn.withColumn("pass", F.floor(F.col("number") / F.col("blocks")).cast("int")).withColumn("place", F.col("number") % F.col("blocks"))
    draws = hash60(F.concat_ws("|", F.lit(seed), "source_index", "pass"))
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    # a prime that doesn't divide the number of blocks makes place -> prime * place + shift a permutation
    prime = F.filter(F.concat(F.slice(primes, 1 + F.col("pass"), len(PRIMES)), primes), lambda p: F.col("blocks") % p != 0)[0]
    big = lambda c: c.cast("decimal(19,0)")
    block = ((big(prime) * big(F.col("place")) + big(draws % F.col("blocks"))) % big(F.col("blocks"))).cast("long")
    return spread.withColumn("block", block).select("source_index", "shard", "pass", "block")


def pack(docs: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """docs(source, size and keys) with source_index, source_size, target and ``start``, the document's place among its source's words.

    Documents are in the order of a hash of keys[0]; ties are in the order of the keys. The place is a
    running sum within a bucket plus the sizes of the buckets before, so that a hot source is not one task.
    """
    bucketed = docs.join(sources, docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    bucketed = bucketed.withColumn("draw", hash60(F.concat(F.lit("pack|"), F.coalesce(F.col(keys[0]).cast("string"), F.lit("")))))
    bucketed = bucketed.withColumn("bucket", (F.col("draw") % BUCKETS).cast("int"))
    before = W.partitionBy("source_index").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = bucketed.groupBy("source_index", "bucket").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("source_index", "bucket").orderBy("draw", *keys, "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        bucketed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["source_index", "bucket"])
        .withColumn("start", F.col("start") + F.col("offset"))
        .drop("draw", "bucket", "offset")
    )


def pieces(packed: DataFrame) -> DataFrame:
    """(source_index, block, start, low, words): the part of each document (known by its start) in each block; low counts from the document's first word."""
    size = F.col("block_words")
    first, last = F.floor(F.col("start") / size).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / size).cast("long")
    low = F.greatest(F.col("start"), F.col("block") * size)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
    return (
        packed.filter("size > 0")
        .select("source_index", "start", "size", "block_words", F.explode(F.sequence(first, last)).alias("block"))
        .select("source_index", "block", "start", (low - F.col("start")).alias("low"), (high - low).alias("words"))
    )


def mix(docs: DataFrame, keys: list[str], seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The documents in their packing order and the pieces of them that the mix holds.

    docs: source string, size long and keys. The pieces are (source_index, start, pass, shard, low, words); with
    (source_index, start) they name a document of positive size. Null sources are one source, empty documents
    (size 0) are packed but never drawn, repeated rows are documents of their own, an empty table gives empty results.
    """
    # the slots grow with the input although they come from a few rows of sources, so their join is never a broadcast
    sources = targets(docs)
    packed = pack(docs, sources, keys)
    return packed, slots(draw(sources, seed), seed).join(pieces(packed).hint("merge"), ["source_index", "block"]).drop("block")


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix: a row for each pass over a document, its text cut to the words the pass holds.

    Same columns as docs, of which doc_id, source and text are used; n_chars, where there is such a column,
    is counted anew. White space stays as it stood before each word. Documents that the mix doesn't draw go.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("source"), F.lit(""))), F.md5(text)))
    keyed = docs.withColumn("__key", key)
    # equal rows are told apart by number; their texts are equal, so any numbering will do
    number = F.row_number().over(W.partitionBy("__key").orderBy("doc_id"))
    small = keyed.select("doc_id", "source", "__key", word_count(F.col("text")).alias("size")).withColumn("__nth", number)
    packed, held = mix(small, ["doc_id", "__key", "__nth"], seed)
    held = held.groupBy("source_index", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("low", "words"))).alias("parts"))
    held = held.join(packed.filter("size > 0").select("source_index", "start", "__key", "__nth"), ["source_index", "start"])
    held = held.groupBy("__key").agg(F.collect_list(F.struct("__nth", "pass", "parts")).alias("__held"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    # the words are found once for all parts of a pass
    cut_to = lambda w: F.flatten(F.transform("__pass.parts", lambda p: F.slice(w, p["low"].cast("int") + 1, p["words"].cast("int"))))
    parts = F.transform(F.array(words), cut_to)[0]
    out = (
        keyed.withColumn("__nth", number)
        .join(held, "__key")
        .withColumn("__pass", F.explode(F.filter("__held", lambda h: h["__nth"] == F.col("__nth"))))
        .withColumn("text", F.regexp_replace(F.array_join(parts, ""), r"^[\x20\x09-\x0D]+", ""))
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    packed, held = mix(docs, ["doc_id"])
    taken = held.groupBy(F.col("source_index").alias("held_by"), "start").agg(F.sum("words").alias("words"))
    joined = packed.withColumn("held_by", F.when(F.col("size") > 0, F.col("source_index"))).join(taken, ["held_by", "start"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def oracle() -> str:
    h = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    b, m = BLOCK_WORDS, MAX_PASSES
    return f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM docs GROUP BY source
), s1 AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][(i % {len(WEIGHTS)}) + 1] AS weight, {m} * source_size AS cap, {SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM s0
), s2 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1
), s3 AS (
  SELECT *, (SELECT arg_min(level, cap / weight) FROM s2 WHERE level * weight <= cap) AS lv FROM s2
), s4 AS (
  SELECT *, ceil(source_size / block_words)::BIGINT AS blocks FROM (
    SELECT source, i, source_size, least(cap::DOUBLE, coalesce(lv * weight, cap::DOUBLE)) AS target,
      greatest(1, least({b}, source_size // {LEAST_BLOCKS}))::BIGINT AS block_words FROM s3)
), d0 AS (
  SELECT i, blocks, least(floor(target / source_size) * blocks + round((target - floor(target / source_size) * source_size) / block_words), blocks * {m})::BIGINT AS n
  FROM s4 WHERE source_size > 0
), j0 AS (
  SELECT i, blocks, unnest(range(n)) AS number FROM d0
), j1 AS (
  SELECT i, blocks, number // blocks AS pass, number % blocks AS place FROM j0
), j2 AS (
  SELECT i, ((list_filter(list_slice([{", ".join(map(str, PRIMES))}], pass + 1, {len(PRIMES)}) || [{", ".join(map(str, PRIMES))}], lambda p: blocks % p <> 0)[1]::HUGEINT * place
    + {h("'mix|' || i || '|' || pass")} % blocks) % blocks)::BIGINT AS block FROM j1
), p0 AS (
  SELECT doc_id, size, s4.i, source_size, target, block_words, {h("'pack|' || coalesce(doc_id::VARCHAR, '')")} AS draw FROM docs JOIN s4 ON docs.source IS NOT DISTINCT FROM s4.source
), p1 AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY i ORDER BY draw % {BUCKETS}, draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER () AS r FROM p0
), p2 AS (
  SELECT r, i, start, size, block_words AS bw, unnest(range(start // block_words, (start + size - 1) // block_words + 1)) AS block FROM p1 WHERE size > 0
), taken AS (
  SELECT r, sum(least(start + size, (p2.block + 1) * bw) - greatest(start, p2.block * bw))::BIGINT AS words FROM p2 JOIN j2 USING (i, block) GROUP BY r
)
SELECT doc_id, size, source_size, target, coalesce(words, 0)::BIGINT AS taken FROM p1 LEFT JOIN taken USING (r)"""
