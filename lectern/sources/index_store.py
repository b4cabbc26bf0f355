"""The index as a store: written by batches, read by version, carried as JSON lines, with what can't be read set apart and an older root to fall back on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.chunking import POLICY
from lectern.sources.batches import batch_name, read_batches, write_batch
from lectern.sources.tables import build_index, index_name, missing

VERSION = 1
KEYS = ("doc_id", "content_hash", "chunk_policy", "embed_model")
CHUNK = (
    "struct<seq:int,id:string,parent_id:string,kind:string,section:string,text:string,page_start:int,page_end:int,para_start:int,para_end:int,sent_start:int,sent_end:int,"
    "anchor_text:string,token_estimate:bigint>"
)
RECORD = f"version int, paper_id string, pdf_hash string, chunk_policy string, embed_model string, chunks array<{CHUNK}>, __corrupt string"
LABEL = ("인덱싱 됨", "chunks")


def ensure_index(spark: SparkSession, docs: DataFrame, path: str, model: str = "", older: Sequence[str] = ()) -> DataFrame:
    """The index of docs(doc_id, text, content_hash) at path after adding what neither it nor the older roots have; what is there is never built again.

    A run that is repeated, or killed and repeated, leaves one copy. Rows without a doc_id are left out.
    """
    have = load_index(spark, [path, *older])
    new = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "content_hash"]) if have is None else missing(docs.filter("doc_id is not null"), have, model)
    if (batch := batch_name(new.select("doc_id", "content_hash"))) is not None:
        write_batch(build_index(new, model), path, batch, ["chunk_policy"])
        have = load_index(spark, [path, *older])
    if have is None:
        return build_index(docs.limit(0), model)
    current = have.filter((F.col("chunk_policy") == POLICY) & (F.col("embed_model") == model))
    return current.join(docs.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_semi")


def load_index(spark: SparkSession, roots: Sequence[str]) -> DataFrame | None:
    """What the roots hold, a version's chunks from the first root that has it; null if no root was ever written."""
    found = None
    for root in roots:
        rows = read_batches(spark, root, KEYS)
        if rows is None:
            continue
        if found is None:
            found = rows
        else:
            found = found.unionByName(rows.join(found.select(*KEYS).distinct(), list(KEYS), "left_anti"), allowMissingColumns=True)
    return found


def to_records(index: DataFrame) -> DataFrame:
    """(name, record): each version of each document as a line of JSON, under its file name."""
    fields = [x.split(":")[0] for x in CHUNK.removeprefix("struct<").removesuffix(">").split(",")]
    chunks = F.sort_array(F.collect_list(F.struct(*fields)))
    rows = index.groupBy(*KEYS).agg(chunks.alias("chunks"))
    record = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.col("doc_id").cast("string").alias("paper_id"), F.col("content_hash").alias("pdf_hash"), "chunk_policy", "embed_model", "chunks"))
    return rows.select(index_name(F.col("doc_id"), F.col("content_hash")).alias("name"), record.alias("record"))


def _fault(r: Column, name: Column) -> Column:
    """Why a record is none of ours; null if it is."""
    named = F.concat(r["paper_id"], F.lit("-"), F.left(r["pdf_hash"], F.lit(16)), F.lit(".json"))
    return (
        F.when(r["__corrupt"].isNotNull() | r.isNull(), "no JSON").when(r["version"].isNull() | (r["version"] != VERSION), "version").when(r["chunks"].isNull(), "no chunks")
        .when(named.isNull() | (name.isNotNull() & (named != name)), "name")
    )


def from_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, rejected) from records(name, record): chunks as build_index gives them, doc_id a string; and (name, reason, record) of what can't be read.

    A record is JSON of this version with chunks, whose document and hash are those of its name; a null name isn't compared. Records of one name count once.
    """
    read = records.select("name", "record", F.from_json(F.coalesce("record", F.lit("")), RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}).alias("r"))
    judged = read.withColumn("reason", _fault(F.col("r"), F.col("name")))
    rejected = judged.filter("reason is not null").select("name", "reason", "record")
    good = judged.filter("reason is null").select(F.col("r.paper_id").alias("doc_id"), F.col("r.pdf_hash").alias("content_hash"), "r.chunk_policy", "r.embed_model", "r.chunks").dropDuplicates(list(KEYS))
    index = good.select(*KEYS, F.explode("chunks").alias("c")).select("doc_id", "c.*", "content_hash", "chunk_policy", "embed_model")
    return index, rejected


def read_records(spark: SparkSession, roots: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of the roots' files of JSON lines: of each name the record of the first root that has a good one, and all that can't be read, with their root."""
    every = None
    for place, root in enumerate(roots):
        lines = spark.read.schema("value string").text(root).select(F.lit(place).alias("place"), F.lit(root).alias("root"), F.col("value").alias("record"))
        every = lines if every is None else every.union(lines)
    read = every.withColumn("r", F.from_json("record", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    judged = read.withColumn("reason", _fault(F.col("r"), F.lit(None).cast("string"))).withColumn("name", F.concat("r.paper_id", F.lit("-"), F.left("r.pdf_hash", F.lit(16)), F.lit(".json")))
    rejected = judged.filter("reason is not null").select("root", "name", "reason", "record")
    best = judged.filter("reason is null").groupBy("name").agg(F.min_by("record", "place").alias("record"))
    return best, rejected


def latest(index: DataFrame) -> DataFrame:
    """(doc_id, content_hash): for each document the version with chunks whose file name sorts last."""
    named = index.select("doc_id", "content_hash").distinct().withColumn("name", index_name(F.col("doc_id"), F.col("content_hash")))
    return named.groupBy("doc_id").agg(F.max_by("content_hash", "name").alias("content_hash"))


def labels(index: DataFrame) -> DataFrame:
    """(doc_id, content_hash, label): how each version's index is called: its mode and how many units are searched."""
    searched = F.count_if(F.col("kind").isin("child", "abstract")).cast("string")
    mode = F.when(T.whole(F.first("embed_model")) != "", "hybrid").otherwise("BM25")
    return index.groupBy("doc_id", "content_hash").agg(F.concat(F.lit(f"{LABEL[0]} · "), mode, F.lit(" · "), searched, F.lit(f" {LABEL[1]}")).alias("label"))
