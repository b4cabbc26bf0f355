"""Tables that grow by batches, each written once however often its run is repeated, and results of costly functions kept in them.

A batch is named by its keys. Writing it overwrites the partitions of that name and no others, so a run that is doubled, or killed and started again, leaves one
copy. Two runs at the same time may write batches that share keys; a reader takes a key's rows from the least batch that has it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import stored


def batch_name(keys: DataFrame) -> str | None:
    """A name for a table of keys whatever their order; null if there are none."""
    digest = F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*keys.columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)"))
    n, total = keys.agg(F.count("*"), digest).first()
    return f"{n}-{total}" if n else None


def write_batch(rows: DataFrame, path: str, batch: str, by: Sequence[str] = ()) -> None:
    """Put rows in the table at path under the batch's name, in place of what is there under it."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)


def read_batches(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The table at path with each key's rows once, as struct columns compare (nulls are equal); null if nothing was ever written there."""
    try:
        # batches are names, even if they look like numbers
        rows = spark.read.option("recursiveFileLookup", "false").parquet(path).withColumn("batch", F.col("batch").cast("string"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    key = F.struct(*[F.struct(F.col(k).alias("k")).alias(k) for k in keys])
    first = rows.select(key.alias("__key"), "batch").groupBy("__key").agg(F.min("batch").alias("batch"))
    return rows.withColumn("__key", key).join(first, ["__key", "batch"], "left_semi").drop("__key", "batch")


def memoized(df: DataFrame, source: str, path: str, function: Callable[[DataFrame], DataFrame], out: str = "value") -> DataFrame:
    """df with ``out``: what function gives for each row's source text, from the memo at path where it is there.

    function takes (key, source) and returns (key, out), a row for each; it gets every distinct text that the memo lacks once, also if most rows have
    the same, and its results are written before they are used. Null texts have a null result and are never asked for. Keys are SHA-256.
    """
    spark = df.sparkSession
    key = F.when(F.col(source).isNotNull(), F.sha2(F.col(source).cast("string"), 256))
    have = read_batches(spark, path, ["key"])
    # one row a text before anything is compared, so a text that most rows share is one row a task
    wanted = df.select(key.alias("key"), F.col(source).alias(source)).filter("key is not null").groupBy("key").agg(F.first(source).alias(source))
    new = stored(wanted if have is None else wanted.join(have.select("key"), "key", "left_anti"))
    if (batch := batch_name(new.select("key"))) is not None:
        write_batch(function(new).select("key", out), path, batch)
        have = read_batches(spark, path, ["key"])
    if have is None:
        return df.withColumn(out, F.lit(None).cast(function(new).schema[out].dataType))
    results = have.select(F.col("key").alias("__key"), F.col(out).alias("__value"))
    return df.drop(out).withColumn("__key", key).join(results, "__key", "left").withColumn(out, F.col("__value")).drop("__key", "__value")
