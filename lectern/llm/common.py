"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """60 bits of MD5 as a long, so that other engines can repeat the draw."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """A double in [0, 1) from 52 bits of MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: A key is hot from this share of all rows on; so there are never more than as many hot keys.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """The inner join of rows with counted, which has one row a key and ``__n``, the number of rows with it; total rows in all.

    Hot keys, at most HOT_SHARE of them, are broadcast; their rows aren't shuffled to one task.
    """
    hot = F.col("__n") * HOT_SHARE > total
    few, many = counted.filter(hot).drop("__n"), counted.filter(~hot).drop("__n")
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(cold.join(many, key))


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: its lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


#: Bits of split_by()'s bitmap for each key, the most it has, and those of a row of it.
BITS_A_KEY, MOST_BITS, ROW_BITS = 16, 1 << 30, 1 << 15


def split_by(rows: DataFrame, key: str, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be in some(key), and rows whose key surely isn't, told apart without a shuffle of rows.

    A bitmap of hashed keys is broadcast, 2 bytes a key (to the next power of two). A row that surely isn't in some may be a null
    key, about one of 16 others that are not in it may be in the first part: what is in some is for a join to say.
    """
    bits = 1 << max(ROW_BITS.bit_length() - 1, min(MOST_BITS.bit_length() - 1, (BITS_A_KEY * some.count() - 1).bit_length()))
    place = F.xxhash64(key).bitwiseAND(bits - 1)
    row, bit = (place / ROW_BITS).cast("int"), place % ROW_BITS
    bitmap = some.filter(F.col(key).isNotNull()).select(row.alias("__row"), bit.alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__row", row).join(F.broadcast(bitmap), "__row", "left").withColumn("__in", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull())
    return found.filter("__in").select(*rows.columns), found.filter("not __in").select(*rows.columns)


def forget(df: DataFrame) -> None:
    """Delete a table that cut() wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
