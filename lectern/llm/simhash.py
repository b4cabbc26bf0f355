"""Near-duplicates by SimHash and ball hashing that meets in the middle (operator 3).

Fingerprints of 64 bits link at RADIUS = 3 or fewer differing bits. Two balls of half that radius
don't always meet, so one of three blocks of bits is left out of the key: of up to three differing
bits some choice leaves at most two, and then the balls of radius one around the two keys meet.
Every distinct fingerprint emits its 131 variants (for each block: the rest as it is and with each of
its bits flipped), the variants are shuffled, and colliding fingerprints are linked where the bits
of the block confirm it:

- equal blocks: the rest differs in two bits at most, so all of them link, each to one of them;
- blocks one bit apart: three bits at most, so one of each side is linked;
- equal rests and blocks three bits apart: found by the same meeting in the middle inside the bucket.

Two differing bits inside one block, or three in any other way, are one of these cases for another
block. A bucket of m fingerprints so gives O(m) links, never all pairs, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import cut, join_counted, split_by, table
from lectern.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: (first bit, bits) of the blocks, one of which is left out of a key.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 15

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a whole text: a bit is set if it is in over half of its shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    lows, highs = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(lows[i : i + CHUNK], highs[i : i + CHUNK], strict=True)), np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([fingerprint(t, shingle) for t in series], dtype="int64")

    return of(text)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _variants(fp: Column) -> Column:
    """The keys of a fingerprint's ball: for each block, the other bits pushed together, unflipped and with each one flipped."""
    keys = []
    for b, (shift, bits) in enumerate(BLOCKS):
        low = fp.bitwiseAND(F.lit((1 << shift) - 1).cast("long"))
        top = shift + bits
        high = F.shiftleft(F.shiftrightunsigned(fp, top), shift) if top < 64 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high).bitwiseOR(F.lit(b << 60).cast("long"))
        flips = F.array(*[F.lit(f).cast("long") for f in [0, *(1 << i for i in range(64 - bits))]])
        keys.append(F.transform(flips, rest.bitwiseXOR))
    return F.concat(*keys)


def _rest(fp: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for n, (shift, bits) in enumerate(BLOCKS):
        low = fp & np.uint64((1 << shift) - 1)
        top = shift + bits
        high = (fp >> np.uint64(top)) << np.uint64(shift) if top < 64 else np.zeros_like(fp)
        out = np.where(b == n, low | high | np.uint64(n << 60), out)
    return out


def _find(sorted_codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted codes are (their index, the index of what they were found as)."""
    at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
    hit = np.flatnonzero(sorted_codes[at] == wanted)
    return hit, at[hit]


def _bucket_links(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links (rows of two fingerprints) among fingerprints that share a key; keys are sorted and whole."""
    same = keys[1:] == keys[:-1]
    shared = np.zeros(len(keys), bool)
    shared[1:] |= same
    shared[:-1] |= same
    keys, fps = keys[shared], fps[shared]
    if not len(keys):
        return np.empty((0, 2), np.uint64)
    block = keys >> np.uint64(60)
    shift, bits = np.array([x for x, _ in BLOCKS], np.uint64)[block], np.array([x for _, x in BLOCKS], np.uint64)[block]
    value = (fps >> shift) & ((np.uint64(1) << bits) - np.uint64(1))
    bucket = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])).astype(np.uint64)
    code = (bucket << np.uint64(22)) | value
    codes, first, back = np.unique(code, return_index=True, return_inverse=True)
    lead = fps[first]
    links = [np.stack([fps, lead[back]], 1)]
    for bit in range(22):
        hit, at = _find(codes, codes ^ np.uint64(1 << bit))
        links.append(np.stack([lead[hit], lead[at]], 1)[hit < at])
    exact = _rest(fps, block) == keys
    links.append(_three_apart(code[exact], fps[exact]))
    links = np.concatenate(links)
    links = links[links[:, 0] != links[:, 1]]
    return np.unique(np.sort(links, 1), axis=0)


def _three_apart(code: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links of equal rests whose blocks differ in three bits.

    One fingerprint of such a pair has an even number of bits in the block. Those emit one flip, the others two
    flips in the same half of the block: of three bits, two are always in one half.
    """
    codes, first = np.unique(code, return_index=True)
    fps = fps[first]
    odd = np.bitwise_count(codes & np.uint64(0x3FFFFF)) % 2 == 1
    if odd.all() or not odd.any():
        return np.empty((0, 2), np.uint64)
    even_codes, even_fps, odd_codes, odd_fps = codes[~odd], fps[~odd], codes[odd], fps[odd]
    found = []
    middle = np.concatenate([even_codes ^ np.uint64(1 << i) for i in range(22)])
    owner = np.tile(even_fps, 22)
    middle, at = np.unique(middle, return_index=True)
    owner = owner[at]
    for half in (range(11), range(11, 22)):
        for i in half:
            for j in half:
                if i < j:
                    hit, at = _find(middle, odd_codes ^ np.uint64(1 << i | 1 << j))
                    found.append(np.stack([odd_fps[hit], owner[at]], 1))
    return np.concatenate(found)


def _linker(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the buckets of a partition sorted by key; a bucket that goes on in the next batch waits for it."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> pd.DataFrame:
        keys, fps = (np.concatenate([w[i] for w in waiting] or [np.empty(0, np.uint64)]) for i in (0, 1))
        links = _bucket_links(keys, fps).view(np.int64)
        waiting.clear()
        return pd.DataFrame({"u": links[:, 0], "v": links[:, 1]})

    for batch in batches:
        keys, fps = batch["key"].to_numpy().view(np.uint64), batch["fp"].to_numpy().view(np.uint64)
        if not len(keys):
            continue
        whole = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
        if whole or waiting and waiting[0][0][-1] != keys[0]:  # else one bucket, which may go on for many batches
            if whole:
                waiting.append((keys[:whole], fps[:whole]))
            yield close()
        waiting.append((keys[whole:], fps[whole:]))
    yield close()


def link(fps: DataFrame) -> DataFrame:
    """(u, v): links between the distinct fingerprints of fps(fp long) that join all pairs within RADIUS bits, directly or by way of others as near."""
    balls = fps.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    return balls.repartition("key").sortWithinPartitions("key").mapInPandas(_linker, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp long, component): a row for each row of docs, component being the least key of its class.

    Classes are the fingerprints within RADIUS bits of each other, directly or by way of others. Null and empty
    texts have fingerprint 0 and are linked like any other; a text of fewer words than a shingle is one shingle;
    null keys never name a class unless it has no other. Repeated rows are kept. An empty table gives no rows.
    Copies are one fingerprint from the start, so a group of copies costs as much as a single text.
    """
    marked = cut(docs.select(F.col(key).alias("key"), fingerprints(F.col(text), shingle).alias("fp")))
    distinct = cut(marked.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("__n")))
    total = distinct.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    labels = components(link(distinct)).select(F.col("node").alias("fp"), "component")
    named = cut(distinct.join(labels, "fp", "left").select("fp", "least", "__n", F.coalesce("component", "fp").alias("label")))
    classes = named.groupBy("label").agg(F.min("least").alias("component"))
    return join_counted(marked, named.join(classes, "label").select("fp", "__n", "component"), "fp", total).select(F.col("key").alias(key), "fp", "component")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each class: that with the least key; of equal rows with that key, one."""
    return keep_least(docs, key, near_duplicates(docs, key, text, shingle))


def keep_least(docs: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """docs with one row of each class of classes(key, component), which has a row for each row of docs."""
    name = lambda c: F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit("null"))
    keys = classes.groupBy(name(key).alias("__key")).agg(F.count("*").alias("__n"), F.max(F.col(key).eqNullSafe(F.col("component"))).alias("__kept"))
    keys = cut(keys.filter("__n > 1 or not __kept").select("__key", "__kept"))
    # a row whose key is kept and has no other row stays as it is: only the rest is shuffled, by the key of the join and of the window alike
    asked, sure = split_by(docs.withColumn("__key", name(key)), "__key", keys.select("__key"))
    order = [F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")]
    kept = asked.join(keys, "__key", "left").filter("coalesce(__kept, true)").withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy(*order)))
    return sure.select(*docs.columns).union(kept.filter("__n = 1").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
