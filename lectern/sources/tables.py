"""Tables, and the chunks of documents with the columns that their index is kept by (see index_store)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.chunking import POLICY, chunk_documents


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the folder that driver and executors share (spark.checkpoint.dir), and read again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def build_documents(raw: DataFrame) -> DataFrame:
    """(doc_id, text, source, content_hash) from raw(doc_id, text, pages, source): the text, or its pages joined; documents without either go (see rejected)."""
    return _built(raw).filter(F.col("text") != "").withColumn("content_hash", T.content_hash(F.col("text")))


def rejected(raw: DataFrame) -> DataFrame:
    """The documents that have nothing to read."""
    return _built(raw).filter(F.col("text") == "").select("doc_id")


def _built(raw: DataFrame) -> DataFrame:
    own = T.trim(T.whole(F.col("text")))
    if "pages" in raw.columns:
        joined = T.trim(F.coalesce(F.array_join(F.transform(F.array_sort("pages"), lambda p: p["text"]), "\n"), F.lit("")))
        own = F.when(own != "", own).otherwise(joined)
    source = F.col("source") if "source" in raw.columns else F.lit("file-text")
    return raw.select("doc_id", own.alias("text"), F.coalesce(source, F.lit("file-text")).alias("source"))


def index_name(doc_id: Column, content_hash: Column) -> Column:
    """The file name of a document's index: id and the first 16 characters of the hash."""
    return F.concat(doc_id.cast("string"), F.lit("-"), F.left(content_hash, F.lit(16)), F.lit(".json"))


def missing(docs: DataFrame, index: DataFrame, model: str = "") -> DataFrame:
    """docs(doc_id, content_hash) that the index doesn't hold under this policy and embedding model; equal pairs once."""
    have = index.filter((F.col("chunk_policy") == POLICY) & (F.col("embed_model") == model)).select("doc_id", "content_hash").distinct()
    return docs.dropDuplicates(["doc_id", "content_hash"]).join(have, ["doc_id", "content_hash"], "left_anti")


def build_index(docs: DataFrame, model: str = "") -> DataFrame:
    """Chunks of docs(doc_id, text, content_hash) with the columns that the index is kept by; versions of a document are chunked apart.

    Rows without a doc_id can't be found again and are left out; equal pairs of id and hash count once.
    """
    versions = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "content_hash"]).withColumn("__version", F.struct("doc_id", "content_hash"))
    chunks = chunk_documents(versions.select(F.col("__version").alias("doc_id"), *[c for c in docs.columns if c not in ("doc_id", "content_hash")]))
    # ids name the document alone, not the version by which it was told apart
    number = lambda c: F.concat(F.col("doc_id.doc_id").cast("string"), F.lit("-"), F.substring_index(c, "-", -1))
    out = chunks.withColumns({"id": number("id"), "parent_id": number("parent_id"), "content_hash": F.col("doc_id.content_hash")}).withColumn("doc_id", F.col("doc_id.doc_id"))
    return out.select(*chunks.columns, "content_hash").withColumns({"chunk_policy": F.lit(POLICY), "embed_model": F.lit(model)})
