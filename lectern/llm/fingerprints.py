"""Document fingerprints by a homomorphic multiset hash (operator 1).

A fingerprint is a wide vector: the sum, modulo powers of two, of vectors hashed from the paragraphs
of a text. It doesn't depend on their order, and paragraphs can be added to or taken from it without
the text (``add``, ``subtract``). It has three parts:

- ``EXACT`` lanes modulo 2^62, hashed from each paragraph as a whole: equality;
- two counts modulo 2^62: paragraphs and sentences;
- ``GRADED`` lanes modulo 2^30, to which each sentence of a paragraph adds a random sign (kept as
  0 or 1; the count of sentences gives the sign back): likeness. The mean square of the difference of
  two such vectors estimates how many sentences the texts don't share. A sentence of LONG_SENTENCE characters or more counts by its words.

Two graded lanes are packed in a long with a guard bit each, so a sum is one addition. All of it
is DataFrame functions; fingerprinting alone needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import table

EXACT = 8
#: 64-bit hashes of a sentence that give the signs; each fills WORDS longs of two lanes.
HASHES, WORDS, PACKED = 4, 30, 2
GRADED = HASHES * WORDS * PACKED
EXACT_MASK = 2**62 - 1
#: Two lanes of 30 bits, 31 bits apart.
LANE_BITS, LANE_STEP = 30, 31
ONES = sum(1 << LANE_STEP * i for i in range(PACKED))
LANES = ONES * (2**LANE_BITS - 1)
GUARDS = ONES << LANE_BITS

PARAGRAPH_END = r"[\r\n]+"
SENTENCE_END = r"[\r\n]+|(?<=[.!?])[ \t]+|(?<=[。！？])"
#: Characters from which a sentence is cut into its words, and those into pieces of WORD_CHARS.
LONG_SENTENCE, WORD_CHARS = 600, 32
PIECE = rf"[^ \t]{{1,{WORD_CHARS}}}+[ \t]*+|[ \t]++"

#: Rows of a range of ids, ranges at most and interpolation points, for finding each document's next one.
RANGE_ROWS, MAX_RANGES, POINTS = 500, 1_000_000, 1000


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as array<long>; null and empty texts have no paragraphs: all zero."""
    whole = F.coalesce(text, F.lit(""))
    pieces = lambda regex: F.filter(F.split(whole, regex), lambda p: p != "")
    hashed = lambda parts, seed: F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))

    def lanes(parts: Column) -> Column:
        exact = F.transform(F.sequence(F.lit(0), F.lit(EXACT - 1)), lambda j: _exact_lane(parts["paragraphs"], j))
        counts = F.array(F.size(parts["paragraphs"]).cast("long"), F.size(parts["h0"]).cast("long"))
        hashes = F.array(*[parts[f"h{j}"] for j in range(HASHES)])
        graded = F.flatten(F.transform(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: _graded_word(h, k))))
        return F.concat(exact, counts, graded)

    # text without sentence ends, or a sentence that goes on and on, is compared by its words
    short = lambda s: F.when(F.length(s) < LONG_SENTENCE, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(PIECE), F.lit(0)))
    sentences = _let(pieces(SENTENCE_END), lambda s: F.when(F.exists(s, lambda x: F.length(x) >= LONG_SENTENCE), F.flatten(F.transform(s, short))).otherwise(s))
    return _let(sentences, lambda s: _let(
        F.struct(pieces(PARAGRAPH_END).alias("paragraphs"), *[hashed(s, 100 + j).alias(f"h{j}") for j in range(HASHES)]), lanes
    ))


def _exact_lane(paragraphs: Column, j: Column) -> Column:
    return F.aggregate(paragraphs, _long(0), lambda a, p: (a + F.xxhash64(j, p).bitwiseAND(_long(EXACT_MASK))).bitwiseAND(_long(EXACT_MASK)))


def _graded_word(hashes: Column, k: Column) -> Column:
    bits = lambda h: F.call_function("shiftrightunsigned", h, k).bitwiseAND(_long(ONES))
    return F.aggregate(hashes, _long(0), lambda a, h: (a + bits(h)).bitwiseAND(_long(LANES)))


_PLAIN = EXACT + 2


def add(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    mask = lambda i: F.when(i < _PLAIN, _long(EXACT_MASK)).otherwise(_long(LANES))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: (x["a"] + x["b"]).bitwiseAND(mask(i)))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of a without those of b."""
    plain = lambda x: (x["a"] - x["b"]).bitwiseAND(_long(EXACT_MASK))
    packed = lambda x: (x["a"] + _long(GUARDS) - x["b"]).bitwiseAND(_long(LANES))
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.when(i < _PLAIN, plain(x)).otherwise(packed(x)))


def signs(fp: Column) -> Column:
    """The graded lanes as sums of signs, array<long>; right for up to 2^29 sentences more of one sign than of the other."""
    lane = lambda w, i: F.shiftright(w, LANE_STEP * i).bitwiseAND(_long(2**LANE_BITS - 1))
    span, half = 2 ** (LANE_BITS + 1), 2**LANE_BITS
    words = F.slice(fp, _PLAIN + 1, HASHES * WORDS)
    centred = lambda c: F.pmod(2 * c - fp[EXACT + 1] + _long(half), _long(span)) - _long(half)
    return F.flatten(F.transform(words, lambda w: F.array(*[centred(lane(w, i)) for i in range(PACKED)])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two arrays of signs(): sentences in both as a share of those in either, by multiplicity; two empty ones are alike."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    shared, either = dot(a, b), lambda s: dot(a, a) + dot(b, b) - s
    return F.when(a == b, 1.0).otherwise(_let(shared, lambda s: F.when(either(s) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / either(s))))))


def to_string(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.hex(x)), "."))


def with_next(docs: DataFrame, key: str, carried: str) -> DataFrame:
    """docs with ``next``, ``guest`` and ``range``: the value of ``carried`` in the next row by key, after the last row the first's.

    Null keys come first and ties are in the order of ``carried``. Rows are shuffled once, into ranges of keys; the
    first rows of a range are dealt to the range before as well, as guests, so every range finds its last row's next by
    itself. Drop the guests in the end.
    """
    least = -(2**63)
    order = F.coalesce(F.col(key), _long(least))
    n, low = docs.agg(F.count("*"), F.min(order)).first()
    if not n:
        return docs.withColumns({"next": F.lit(None).cast(docs.schema[carried].dataType), "guest": F.lit(False), "range": F.lit(0).cast("long")})
    ranges = min(MAX_RANGES, n // RANGE_ROWS + 1)
    points = min(POINTS, ranges)
    bounds = docs.agg(F.percentile_approx(key, [i / points for i in range(points + 1)], 10_000)).first()[0] or [low]
    bounds = sorted({low, *bounds})
    fine = -(-ranges // points)
    at = F.size(F.filter(F.array(*map(_long, bounds)), lambda b: b <= order)) - 1
    start, end = F.array(*map(_long, bounds))[at], F.array(*map(_long, [*bounds[1:], min(bounds[-1], 2**63 - 2) + 1]))[at]
    inside = F.least(F.lit(fine - 1), F.floor((order.cast("double") - start) * fine / F.greatest(F.lit(1.0), end.cast("double") - start)).cast("int"))
    ranged = docs.withColumn("__range", (at * fine + inside).cast("long"))
    heads = ranged.groupBy("__range").agg(F.min(order).alias("__head"))
    by_range = W.orderBy("__range")
    last = F.max("__range").over(W.partitionBy())
    # at most MAX_RANGES * 2 rows, so small enough to broadcast
    heads = heads.select("__head", F.coalesce(F.lag("__range").over(by_range), last).alias("__before"))
    dealt = ranged.join(F.broadcast(heads), order == F.col("__head"), "left")
    dealt = dealt.withColumn("__guest", F.explode(F.when(F.col("__before").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = dealt.withColumn("__range", F.when(F.col("__guest"), F.col("__before")).otherwise(F.col("__range")))
    inside_range = W.partitionBy("__range").orderBy("__guest", F.col(key).asc_nulls_first(), carried)
    return dealt.withColumn("next", F.lead(carried).over(inside_range)).drop("__head", "__before").withColumnsRenamed({"__guest": "guest", "__range": "range"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, "doc_id", "text").withColumn("fp", fingerprint(F.col("text")))
    # same ranges, same order: no further shuffle
    paired = paired.withColumn("next_fp", F.lead("fp").over(W.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text"))).filter(~F.col("guest"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    return (
        paired.withColumn("edited", edited)
        .withColumn("edited_fp", fingerprint(F.col("edited")))
        .withColumns({"s": signs(F.col("fp")), "s_edited": signs(F.col("edited_fp")), "s_next": signs(F.col("next_fp"))})
        .select(
            "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            to_string(F.col("fp")).alias("fingerprint"), to_string(F.col("edited_fp")).alias("edited_fingerprint"),
            likeness(F.col("s"), F.col("s_edited")).alias("near_edited"), likeness(F.col("s"), F.col("s_next")).alias("near_next"),
        )
    )
