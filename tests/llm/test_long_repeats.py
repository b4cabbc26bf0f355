from pyspark.sql import functions as F

from lectern.llm import fingerprints as fp


def test_likeness_of_a_line_repeated_often(spark):
    one = spark.range(1).select(fp.fingerprint(F.lit("The same line.")).alias("f")).first()["f"]
    # the fingerprints of the line 20,000 and 10,000 times: sums in lanes that don't wrap
    rows = spark.createDataFrame([([x * 20_000 & (2**62 - 1) for x in one], [x * 10_000 & (2**62 - 1) for x in one])], "a array<long>, b array<long>")
    signed = rows.select(fp.signs(F.col("a")).alias("a"), fp.signs(F.col("b")).alias("b"))
    near, top, low = signed.select(fp.likeness(F.col("a"), F.col("b")), F.array_max("a"), F.array_min("a")).first()
    assert abs(near - 2 / 3) < 1e-9 and (top, low) == (20_000, -20_000)
