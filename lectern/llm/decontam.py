"""Benchmark decontamination by training suffix arrays (operator 7).

The documents of a task are cut into shards of about ``SHARD_BYTES``; every shard gets a suffix
array over its words, and every test suffix is binary-searched in it. The range of equal suffixes
gives all places of a window; runs of places on one diagonal are joined to the longest verbatim
matches. Suffixes are sorted and compared to the depth of a window, and those whose first words
begin no test suffix are left out before sorting: they can hold no match.

Documents are never shuffled: shards are searched where they are read. The test set travels to the
shards in blocks of ``BLOCK_WINDOWS`` windows at most, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table

WINDOW = 10
SHARD_BYTES = 2_000_000
#: Windows of test text that one pass over the documents searches for.
BLOCK_WINDOWS = 200_000
#: First words by which suffixes are left out.
PREFIX = 3

MATCHES = "array<struct<item_id:string,doc_word:long,item_word:long,words:long>>"

_rng = np.random.default_rng(7)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _VALUE[_LOWER]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_VALUE[~_IS_WORD] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; words are runs of digits, a-z and anything beyond ASCII."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + SHARD_BYTES)
        while end < len(data) and _IS_WORD[data[end]]:  # a piece ends where a word ends
            end += 1
        found.append(_piece_hashes(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _piece_hashes(b: np.ndarray) -> np.ndarray:
    word = _IS_WORD[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    b, word = b[starts[0] :], word[starts[0] :]
    starts = (starts - starts[0]).astype(np.int64)
    lengths = np.diff(np.append(starts, len(b)))
    place = np.arange(len(b), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
    value = _VALUE[b] * _powers(int(lengths.max()))[place]
    h = np.add.reduceat(value, starts)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.where(h == 0, np.uint64(1), h)  # 0 parts documents


def _prefix_key(h: np.ndarray, at: np.ndarray | None, k: int) -> np.ndarray:
    """A hash of the k words from each place; h must go on for k - 1 words after the last."""
    n = len(h) - (k - 1)
    key = np.zeros(n if at is None else len(at), np.uint64)
    for j in range(k):
        key = key * _BASE + (h[j : n + j] if at is None else h[at + j])
    return key


class TestBlock:
    """Windows of test items: all windows of WINDOW words, or the whole item where it is shorter."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        ids, offsets, rows, lengths = [], [], [], []
        for n, (_, text) in enumerate(items):
            h = word_hashes((text or "").encode())
            size = min(window, len(h))
            for o in range(len(h) - size + 1 if size else 0):
                rows.append(np.pad(h[o : o + size], (0, window - size)))
                ids.append(n), offsets.append(o), lengths.append(size)
        self.names = [name for name, _ in items]
        self.item, self.offset, self.length = np.array(ids, np.int64), np.array(offsets, np.int64), np.array(lengths, np.int64)
        self.words = np.array(rows, np.uint64).reshape(len(rows), window)
        self.window, self.k = window, int(min([PREFIX, *lengths]))
        self.keys = _prefix_key(self.words.ravel(), np.arange(len(rows)) * window, self.k) if rows else np.empty(0, np.uint64)
        self.sorted_keys = np.unique(self.keys)
        self.bits = np.zeros(2**20, bool)
        self.bits[self.sorted_keys >> np.uint64(44)] = True

    def suffix_array(self, h: np.ndarray) -> np.ndarray:
        """Places of the suffixes that begin like some test suffix, in the order of their first words."""
        if len(h) <= self.window or not len(self.item):
            return np.empty(0, np.int64)
        key = _prefix_key(h, None, self.k)
        at = np.flatnonzero(self.bits[key >> np.uint64(44)])
        key = key[at]
        near = np.minimum(np.searchsorted(self.sorted_keys, key), len(self.sorted_keys) - 1)
        at = at[self.sorted_keys[near] == key]
        return at[np.lexsort([h[at + j] for j in range(self.window - 1, -1, -1)])]

    def _bound(self, sa: np.ndarray, h: np.ndarray, tests: np.ndarray, upper: bool) -> np.ndarray:
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(sa), np.int64)
        words, length = self.words[tests], self.length[tests]
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            order = np.zeros(len(tests), np.int8)
            for j in range(self.window):
                there = h[sa[mid] + j]
                undecided = (order == 0) & (j < length)
                order[undecided & (there < words[:, j])] = -1
                order[undecided & (there > words[:, j])] = 1
            right = open_ & ((order < 0) | (upper & (order == 0)))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    def search(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, item, offset, words) of the longest matches in a shard, by place."""
        sa = self.suffix_array(h)
        if not len(sa):
            return (np.empty(0, np.int64),) * 4
        tests = np.flatnonzero(np.isin(self.keys, np.unique(_prefix_key(h, sa, self.k))))
        low, high = self._bound(sa, h, tests, False), self._bound(sa, h, tests, True)
        n = high - low
        test = np.repeat(tests, n)
        place = sa[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        item, offset, length = self.item[test], self.offset[test], self.length[test]
        order = np.lexsort([place, place - offset, item])
        place, item, offset, length = place[order], item[order], offset[order], length[order]
        new = np.ones(len(place), bool)
        new[1:] = (item[1:] != item[:-1]) | (place[1:] - offset[1:] != place[:-1] - offset[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(place)) - 1
        words = place[end] + length[end] - place[begin] if len(place) else np.empty(0, np.int64)
        order = np.lexsort([item[begin], place[begin]])
        return place[begin][order], item[begin][order], offset[begin][order], words[order]


def _search_texts(texts: list[str | None], block: TestBlock) -> tuple[list[int], list[list[tuple]]]:
    """Number of words and matches of each text, shard by shard."""
    counts, matches = [], [[] for _ in texts]
    shard, first, size = [], [], 0

    def close(upto: int):
        h = np.concatenate([*(x for h in shard for x in (h, np.zeros(1, np.uint64))), np.zeros(block.window, np.uint64)])
        starts = np.cumsum([0, *(len(h) + 1 for h in shard)])
        place, item, offset, words = block.search(h)
        doc = np.searchsorted(starts, place, "right") - 1
        for d, p, i, o, w in zip(doc.tolist(), (place - starts[doc]).tolist(), item.tolist(), offset.tolist(), words.tolist(), strict=True):
            matches[upto - len(shard) + d].append((block.names[i], p, o, w))

    for n, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        shard.append(word_hashes(data))
        counts.append(len(shard[-1]))
        size += len(data)
        if size >= SHARD_BYTES:
            close(n + 1)
            shard, size = [], 0
    if shard:
        close(len(texts))
    return counts, matches


def _searcher(block: TestBlock):
    @F.pandas_udf(f"struct<n_words:long,matches:{MATCHES}>")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            counts, matches = _search_texts(series.tolist(), block)
            yield pd.DataFrame({"n_words": counts, "matches": pd.Series([[dict(zip(("item_id", "doc_word", "item_word", "words"), m, strict=True)) for m in ms] for ms in matches], dtype=object)})

    return search


def find_matches(docs: DataFrame, text: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words long and matches: the longest verbatim matches of at least a window with an item.

    A window is ``window`` words of an item, or the whole item if it has fewer words but any. Null texts have no
    words and items without words match nothing; a null item_id is the empty string; items of equal id count as
    one. Ties and repeated rows are each searched. Columns of docs named n_words or matches are replaced.
    """
    listed = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("t")).filter("t is not null")
    # a word takes a character and a separator at least
    total = listed.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    blocks = int(total // BLOCK_WINDOWS) + 1
    part = F.pmod(F.xxhash64("id", "t"), F.lit(blocks))
    out, found = docs.drop("n_words", "matches"), []
    for b in range(blocks):
        rows = listed.filter(part == b).distinct().orderBy("id", "t").collect()
        out = out.withColumn(f"__found{b}", _searcher(TestBlock([tuple(r) for r in rows], window))(F.col(text)))
        found.append(f"__found{b}")
    return out.withColumn("n_words", F.col(f"{found[0]}.n_words")).withColumn("matches", F.concat(*[F.col(f"{f}.matches") for f in found])).drop(*found)


def covered(matches: Column) -> Column:
    """Number of words inside any of the matches."""
    spans = F.sort_array(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("low"), (m["doc_word"] + m["words"]).alias("high"))))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda s, m: F.struct(
        F.greatest(s["upto"], m["high"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), m["high"] - F.greatest(s["upto"], m["low"]))).cast("long").alias("n")
    )
    return F.aggregate(spans, start, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a match, with the columns of docs."""
    return find_matches(docs, text, items, window=window).filter(F.size("matches") == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hit = covered(F.col("matches"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
