"""Language-model scoring by Brown class-based bigrams (operator 8).

log P(text) is the sum over its tokens of log P(class | class of the word before) + log P(word | class).
Exchange clustering assigns the classes, in two steps:

- The ``FREQUENT`` most frequent words and ``GROUPS`` groups of all others, by a hash of their ending, are units. They are
  moved one after another to the class that raises the likelihood of the unit bigrams most, until none moves. That matrix
  has (FREQUENT + GROUPS + 1)^2 cells at any input size.
- Every word seen ``LEAST`` times or more then moves by itself, by the classes of the words before its own places: each
  round holds the counts of the last one, half of the words may move in it, and the rounds end when the likelihood
  rises by less than ``TOLERANCE``. The words lie in a table, so this vocabulary grows with the corpus; only class counts come to the
  driver. Rarer and unseen words stay with their group.

Texts are read and numbered once, in shards of about ``SHARD_CHARS`` that are written with their words. Words are dealt out by
CRC32 to buckets, of which a row holds many words of one. A word's contexts are summed in its task first, then over all;
its count and class go back to the shards that hold it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, forget, table

CLASSES = 64
FREQUENT = 1000
GROUPS = 256
#: The last code points of a word, by which rarer words are grouped.
ENDING = 3
#: Occurrences from which a word has a class of its own choice.
LEAST = 3
#: Share by which the log-likelihood has to rise for another round.
TOLERANCE = 1e-4
SHARD_CHARS = 8_000_000
#: Words of a shard that are handed on at a time.
HANDED = 50_000
#: Contexts of words that a task sums at a time.
SUMMED = 700_000
#: Words for which classes are chosen at a time.
CHOSEN = 1000
#: Counts that smoothing adds to each transition and each word of a class.
ADD_TRANSITION, ADD_WORD = 0.1, 0.5

#: The unit of a text's end; it is a class of its own.
END = FREQUENT + GROUPS
UNITS = END + 1

#: A context and its count; greater counts take several cells.
_CONTEXT = np.dtype([("unit", "<u2"), ("n", "<u2")])
_FULL = 2**16 - 1


def group(word: bytes) -> int:
    tail = word[-ENDING:]
    return zlib.crc32(tail if tail.isascii() else word.decode("utf-8", "replace")[-ENDING:].encode()) % GROUPS


@dataclass
class Model:
    """frequent: word -> (unit, count, class). context: class of each unit as the word before. transition: log10 P(class | class before).

    denominator: of each class' words. With it goes a table of all other words, (word, n, class).
    """

    tokens: int
    distinct: int
    ends: int
    frequent: dict[bytes, tuple[int, int, int]]
    context: np.ndarray
    transition: np.ndarray
    denominator: np.ndarray

    def unit(self, word: bytes) -> int:
        return self.units([word])[0]

    def units(self, words: list[bytes]) -> list[int]:
        return units_of(words, {w: x[0] for w, x in self.frequent.items()})


class _Groups(dict):
    """group() by endings in ASCII, kept once found; -1 for others, for which the whole word is needed."""

    def __missing__(self, tail: bytes) -> int:
        if not tail.isascii():
            return -1
        self[tail] = found = group(tail)
        return found


_GROUPS = _Groups()


def units_of(words: list[bytes], units: dict[bytes, int]) -> list[int]:
    """Each word's unit; units has those of the frequent words."""
    return [units[w] if w in units else FREQUENT + (g if (g := _GROUPS[w[-ENDING:]]) >= 0 else group(w)) for w in words]


def packed(x: np.ndarray) -> bytes:
    """The array compressed, its bytes by planes: those of one place, of which the high ones are mostly 0, lie together."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _numbers() -> defaultdict:
    """A dict that gives every new key the next number."""
    ids = defaultdict()
    ids.default_factory = ids.__len__
    return ids


def number_texts(docs: DataFrame, key: str, text: str, training: Column) -> DataFrame:
    """The texts in shards, a row each: keys, which texts are for training, their lengths, the numbers of their words (packed), the words and their counts (packed)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"shard long, keys array<{kind}>, training array<boolean>, lengths array<long>, ids binary, words binary, n_training binary"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, parts, chars = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            keys, training = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
            lengths, found = np.concatenate([p[2] for p in parts]), pa.concat_arrays([p[3] for p in parts]).dictionary_encode()
            ids = found.indices.to_numpy().astype(np.int32)
            seen = ids[np.repeat(training.to_numpy(zero_copy_only=False), lengths)]
            n_training = np.bincount(seen, minlength=len(found.dictionary)).astype(np.int64)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            binary = lambda x: pa.array([x], pa.binary())
            row = [pa.array([task << 32 | made]), whole(keys), whole(training), whole(pa.array(lengths, pa.int64())), binary(packed(ids)), pc.binary_join(whole(found.dictionary), " ").cast(pa.binary()), binary(packed(n_training))]
            return pa.RecordBatch.from_arrays(row, names=[c.split(" ")[0] for c in schema.split(", ")])

        for batch in batches:
            texts = batch["text"].fill_null("")
            sizes, at = pc.utf8_length(texts).to_numpy().cumsum(dtype=np.int64), 0
            while at < len(batch):
                # texts until the shard is full, the one that fills it included
                end = min(int(np.searchsorted(sizes, SHARD_CHARS - chars + (sizes[at - 1] if at else 0))) + 1, len(batch))
                words_ = pc.ascii_split_whitespace(pc.ascii_lower(texts[at:end]))
                found = words_.flatten()
                # white space at an end of a text leaves an empty string there
                there = pc.greater(pc.binary_length(found), 0)
                before = np.concatenate([[0], there.to_numpy(zero_copy_only=False).cumsum()])
                ends = np.concatenate([[0], pc.list_value_length(words_).to_numpy().cumsum()])
                parts.append((batch["key"][at:end], batch["training"][at:end], np.diff(before[ends]), found.filter(there)))
                chars += int(sizes[end - 1] - (sizes[at - 1] if at else 0))
                at = end
                if chars >= SHARD_CHARS:
                    yield shard()
                    made, parts, chars = made + 1, [], 0
        if parts:
            yield shard()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training")).mapInArrow(number, schema)


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(shard, words, counts of the words in training texts, numbers of each text's words, which are for training)."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            ids = unpacked(r.ids, np.int32)
            yield r.shard, r.words.split(), unpacked(r.n_training, np.int64), np.split(ids, np.cumsum(r.lengths)[:-1]), r.training


def frequent_words(shards: DataFrame) -> list[bytes]:
    """The FREQUENT words with the greatest counts over all training texts, of equal ones the least, however the texts are cut into shards."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for words_, counts in (row for batch in batches for row in zip(batch["words"], batch["n_training"], strict=True)):
            n, found = unpacked(counts, np.int64), words_.split()
            for a in range(0, len(found), HANDED):
                at = a + np.flatnonzero(n[a : a + HANDED])
                yield pd.DataFrame({"word": pd.Series([found[i].decode("utf-8", "replace") for i in at.tolist()], dtype=object), "n": n[at]})

    counted = shards.select("words", "n_training").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"].encode() for r in counted.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def _buckets(spark: SparkSession) -> int:
    """Number of buckets of words, some for each partition."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _dealt(names: list[bytes], buckets: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Order of the words by bucket, the buckets that have any, and where each starts in that order, and the last ends."""
    of = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    return order, of[order[first]].tolist(), [*first.tolist(), len(names)]


def _named(names: list[bytes], order: np.ndarray) -> list[bytes]:
    return [names[i] for i in order.tolist()]


def _numbered(names: list[bytes], ids: defaultdict) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, names), np.int64, len(names))


def _summed(parts: list[tuple], buckets: int = 1) -> pd.DataFrame:
    """A row for each bucket of the words of the parts (words, cells, times): its words, and of each the number of cells, and the cells as _CONTEXT (packed).

    A cell is the word's number in its part times UNITS plus unit. Equal cells are summed.
    """
    ids = _numbers()
    places = [_numbered(names, ids) for names, _, _ in parts]
    order, of, ends = _dealt(list(ids), buckets)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names = _named(list(ids), order)
    cells = np.concatenate([rank[place[cells // UNITS]] * UNITS + cells % UNITS for place, (_, cells, _) in zip(places, parts)])
    times = np.concatenate([x for *_, x in parts])
    if times.max() <= _FULL and len(names) * UNITS < 2**47:
        cells = np.sort(cells << 16 | times)
        cells, times = cells >> 16, cells & _FULL
    else:
        order = np.argsort(cells, kind="stable")
        cells, times = cells[order], times[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    cells, times = _split(cells[first], np.add.reduceat(times, first))
    held = np.empty(len(cells), _CONTEXT)
    held["unit"], held["n"] = cells % UNITS, times
    sizes = np.bincount(cells // UNITS, minlength=len(names)).astype(np.int32)
    bounds = np.searchsorted(cells, np.array(ends) * UNITS).tolist()
    return pd.DataFrame({
        "bucket": of, "words": [b" ".join(names[a:b]) for a, b in zip(ends, ends[1:])], "sizes": [packed(sizes[a:b]) for a, b in zip(ends, ends[1:])],
        "contexts": [packed(held[a:b]) for a, b in zip(bounds, bounds[1:])],
    })


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(words, number of cells of each, cells) of the rows of _summed(). The empty word is a text's end."""
    for batch in batches:
        for names, sizes, held in zip(batch["words"], batch["sizes"], batch["contexts"], strict=True):
            yield names.split(b" "), unpacked(sizes, np.int32), unpacked(held, _CONTEXT)


def context_blocks(shards: DataFrame, frequent: list[bytes]) -> DataFrame:
    """How often each training word stands after each unit: a row for each bucket of words, as _blocks() reads it."""
    units, buckets = {w: u for u, w in enumerate(frequent)}, _buckets(shards.sparkSession)

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # frequent words and the end are summed over all shards of a task, others over some
        hot, parts, held = np.zeros((FREQUENT + 1) * UNITS, np.int64), [], 0
        for _, found, _, texts, training in _shards(batches):
            unit = np.array([*units_of(found, units), END], np.int64)
            end = np.array([len(found)], np.int32)
            ids = np.concatenate([end, *(x for t, use in zip(texts, training, strict=True) if use for x in (t, end))])
            cells = ids[1:].astype(np.int64)
            cells *= UNITS
            cells += unit[ids[:-1]]
            to = unit[ids[1:]]
            often = (to < FREQUENT) | (to == END)
            np.add.at(hot, np.minimum(to[often], FREQUENT) * UNITS + cells[often] % UNITS, 1)
            cells = cells[~often]
            cells.sort()
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            times, cells = np.diff(np.append(first, len(cells))), cells[first]
            if len(cells):
                owner = cells // UNITS
                new = np.diff(owner, prepend=-1) > 0
                parts.append((_named(found, owner[new]), (np.cumsum(new) - 1) * UNITS + cells % UNITS, times))
                held += len(cells)
            if held >= SUMMED:
                yield _summed(parts, buckets)
                parts, held = [], 0
        cells = np.flatnonzero(hot)
        if len(cells):
            owner = cells // UNITS
            new = np.diff(owner, prepend=-1) > 0
            parts.append(([frequent[i] if i < FREQUENT else b"" for i in owner[new].tolist()], (np.cumsum(new) - 1) * UNITS + cells % UNITS, hot[cells]))
        if parts:
            yield _summed(parts, buckets)

    def over_tasks(bucket: pd.DataFrame) -> pd.DataFrame:
        return _summed([(names, np.repeat(np.arange(len(names)), sizes) * UNITS + held["unit"], held["n"].astype(np.int64)) for names, sizes, held in _blocks(iter([bucket]))])[["words", "sizes", "contexts"]]

    dealt = shards.mapInPandas(in_task, "bucket int, words binary, sizes binary, contexts binary")
    return dealt.groupBy("bucket").applyInPandas(over_tasks, "words binary, sizes binary, contexts binary")


def contexts(shards: DataFrame, frequent: list[bytes]) -> DataFrame:
    """(word, n, contexts): context_blocks() with a row for each word, its contexts as bytes of _CONTEXT. The empty word is a text's end."""

    def one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, sizes, held in _blocks(batches):
            yield _rows([w.decode("utf-8", "replace") for w in names], np.repeat(np.arange(len(names)), sizes) * UNITS + held["unit"], held["n"].astype(np.int64))

    return context_blocks(shards, frequent).mapInPandas(one_by_one, "word string, n long, contexts binary")


def _split(cells: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells with greater counts than _CONTEXT holds several times, with parts of the counts."""
    if not len(times) or times.max() <= _FULL:
        return cells, times
    parts = -(-times // _FULL)
    ends = np.cumsum(parts) - 1
    rest = times - (parts - 1) * _FULL
    cells, times = np.repeat(cells, parts), np.full(parts.sum(), _FULL)
    times[ends] = rest
    return cells, times


def _rows(names: list[str], cells: np.ndarray, times: np.ndarray) -> pd.DataFrame:
    """(word, n, contexts) of the words that occur, from sorted cells, number of the word times UNITS plus unit."""
    cells, times = _split(cells, times)
    held = np.empty(len(cells), _CONTEXT)
    held["unit"], held["n"] = cells % UNITS, times
    owner = cells // UNITS
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(cells) else np.empty(0, np.int64)
    data, ends = held.tobytes(), [*first[1:].tolist(), len(cells)]
    return pd.DataFrame({
        "word": pd.Series([names[i] for i in owner[first]], dtype=object), "n": np.add.reduceat(times, first) if len(first) else np.empty(0, np.int64),
        "contexts": pd.Series([data[a * _CONTEXT.itemsize : b * _CONTEXT.itemsize] for a, b in zip(first.tolist(), ends)], dtype=object),
    })


def unit_bigrams(found: DataFrame, frequent: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbouring units, and distinct words of each unit, from context_blocks()."""
    units = {w: u for u, w in enumerate(frequent)} | {b"": END}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, kinds = np.zeros(UNITS * UNITS, np.int64), np.zeros(UNITS, np.int64)
        for names, sizes, held in _blocks(batches):
            unit = np.array(units_of(names, units), np.int64)
            np.add.at(cells, held["unit"].astype(np.int64) * UNITS + np.repeat(unit, sizes), held["n"].astype(np.int64))
            kinds += np.bincount(unit, minlength=UNITS)
        table_ = [*cells.reshape(UNITS, UNITS), kinds]
        at = [i for i, row in enumerate(table_) if row.any()]
        yield pd.DataFrame({"row": at, "n": [packed(table_[i]) for i in at]})

    def total(of_row: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": of_row["row"][:1], "n": [packed(sum(unpacked(x, np.int64) for x in of_row["n"]))]})

    # UNITS rows of the table and one with the distinct words, at any input size
    out = np.zeros((UNITS + 1, UNITS))
    for r in found.mapInPandas(count, "row int, n binary").groupBy("row").applyInPandas(total, "row int, n binary").collect():
        out[r["row"]] = unpacked(r["n"], np.int64)
    return out[:UNITS], out[UNITS]


def _xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each unit, the end in the last class alone; units start in turn by frequency and move until none gains."""
    n = bigrams.sum(0)
    order = [u for u in np.argsort(-n, kind="stable") if u != END]
    class_of = np.full(UNITS, classes)
    class_of[order] = np.arange(len(order)) % classes
    member = np.zeros((UNITS, classes + 1))
    member[np.arange(UNITS), class_of] = 1
    m = member.T @ bigrams @ member
    size = m.sum(0)
    moved = 1
    while moved:
        moved = 0
        for u in order:
            if not n[u]:
                continue
            a, self_ = class_of[u], bigrams[u, u]
            right, left = bigrams[u] @ member, bigrams[:, u] @ member
            right[a] -= self_
            left[a] -= self_
            m[a] -= right
            m[:, a] -= left
            m[a, a] -= self_
            size[a] -= n[u]
            rows = (_xlogx(m + right) - _xlogx(m)).sum(1) + (_xlogx(m + left[:, None]) - _xlogx(m)).sum(0)
            d = np.diag(m)
            rows += _xlogx(d + right + left + self_) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain = rows - 2 * (_xlogx(size + n[u]) - _xlogx(size))
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            moved += b != a
            m[b] += right
            m[:, b] += left
            m[b, b] += self_
            size[b] += n[u]
            member[u, a], member[u, b] = 0, 1
            class_of[u] = b
    return class_of


#: Counts of a context up to which gains are looked up.
SMALL = 64


def gains(pairs: np.ndarray) -> np.ndarray:
    """What 1 to SMALL more tokens add to x log x of each cell, looked up by choose()."""
    pairs = pairs[:, :CLASSES]
    return _xlogx(pairs + np.arange(1, SMALL + 1)[:, None, None]) - _xlogx(pairs)


def by_class(context: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' contexts, classes with counts, with each class once a word: where each word's start, classes and counts."""
    owner = np.repeat(np.arange(len(sizes)), sizes) * (CLASSES + 1)
    cells = np.bincount(owner + context, times, len(sizes) * (CLASSES + 1)).astype(np.int64)
    at = np.flatnonzero(cells)
    return np.searchsorted(at, np.arange(len(sizes)) * (CLASSES + 1)), at % (CLASSES + 1), cells[at]


def choose(own: np.ndarray, starts: np.ndarray, context: np.ndarray, times: np.ndarray, pairs: np.ndarray, looked_up: np.ndarray) -> np.ndarray:
    """The class that suits each word best while all others stay: own is its class, from starts on are its contexts and their counts."""
    pairs, total = pairs[:, :CLASSES], pairs[:, :CLASSES].sum(0)
    n = np.add.reduceat(times, starts)
    added = looked_up[np.minimum(times, SMALL) - 1, context]
    many = np.flatnonzero(times > SMALL)
    added[many] = _xlogx(pairs[context[many]] + times[many, None]) - _xlogx(pairs[context[many]])
    kinds, kind = np.unique(n, return_inverse=True)
    gain = np.add.reduceat(added, starts) - (_xlogx(total + kinds[:, None]) - _xlogx(total))[kind]
    rows = np.arange(len(own))
    there = pairs[context, np.repeat(own, np.diff(np.append(starts, len(context))))]
    gain[rows, own] = np.add.reduceat(_xlogx(there) - _xlogx(there - times), starts) - (_xlogx(total[own]) - _xlogx(total[own] - n))
    best = gain.argmax(1)
    return np.where(gain[rows, best] > gain[rows, own] + 1e-6, best, own)


def refine(found: DataFrame, frequent: list[bytes], class_of: np.ndarray, bigrams: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of every training word, and the counts of class before and class, by rounds of exchange over single words."""
    units = {w: u for u, w in enumerate(frequent)} | {b"": END}
    member = np.zeros((UNITS, CLASSES + 1))
    member[np.arange(UNITS), class_of] = 1
    pairs = member.T @ bigrams @ member
    # half: in which turns the words move, or 2: never. of_classes, before, times: of each word the number of classes before it, these and their counts (packed).
    # Rows without words hold the counts by class before and class that the words of a task have
    schema = "half int, words binary, n binary, class binary, of_classes binary, before binary, times binary, pairs array<long>"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def row(half: int, names: list[bytes], n: np.ndarray, own: np.ndarray, of_classes=(), before=(), times=()) -> tuple:
        return half, b" ".join(names), packed(n), packed(own.astype(np.uint8)), packed(np.array(of_classes, np.int32)), packed(np.array(before, np.uint8)), packed(np.array(times, np.int64)), None

    def add(cells: np.ndarray, own: np.ndarray, of_classes: np.ndarray, before: np.ndarray, times: np.ndarray) -> None:
        np.add.at(cells, before.astype(np.int64) * (CLASSES + 1) + np.repeat(own, of_classes), times)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each word with its unit's class; those that may move with the classes before them."""
        cells = np.zeros((2, (CLASSES + 1) ** 2), np.int64)
        for names, sizes, held in _blocks(batches):
            starts = np.cumsum(sizes) - sizes
            n, own = np.add.reduceat(held["n"].astype(np.int64), starts), class_of[units_of(names, units)]
            end = own == CLASSES
            half = np.where(n >= LEAST, np.fromiter(map(zlib.crc32, names), np.int64, len(names)) >> 8 & 1, 2)
            rows, owner = [], np.repeat(np.arange(len(names)), sizes)
            for h in range(3):
                at = np.flatnonzero((half == h) & ~end)
                theirs = np.isin(owner, at) if h < 2 and len(at) else None
                more = ()
                if theirs is not None:
                    begin, before, times = by_class(class_of[held["unit"][theirs]], held["n"][theirs], sizes[at])
                    more = np.diff(np.append(begin, len(times))), before, times
                    add(cells[h], own[at], *more)
                rows.append(row(h, _named(names, at), n[at], own[at], *more))
            yield pd.DataFrame([r for r in rows if r[1]], columns=columns)
        yield pd.DataFrame([(h, *[None] * 6, cells[h].tolist()) for h in range(2)], columns=columns)

    def moving(half: int, pairs: np.ndarray):
        """A round in which the words of a half may move."""

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, looked_up = np.zeros((CLASSES + 1) ** 2, np.int64), gains(pairs)
            for batch in batches:
                moved = []
                for own, of_classes, before, times in zip(*(batch[c] for c in ("class", "of_classes", "before", "times")), strict=True):
                    own, of_classes = unpacked(own, np.uint8).astype(np.int64), unpacked(of_classes, np.int32)
                    before, times = unpacked(before, np.uint8), unpacked(times, np.int64)
                    starts = np.append(0, np.cumsum(of_classes))
                    for a in range(0, len(own), CHOSEN):
                        b = min(a + CHOSEN, len(own))
                        at = slice(starts[a], starts[b])
                        own[a:b] = choose(own[a:b], starts[a:b] - starts[a], before[at], times[at], pairs, looked_up)
                    add(cells, own, of_classes, before, times)
                    moved.append(packed(own.astype(np.uint8)))
                yield batch.assign(**{"class": moved})
            yield pd.DataFrame([(half, *[None] * 6, cells.tolist())], columns=columns)

        return move

    def counted(after: DataFrame, half: int) -> np.ndarray:
        """The counts by class before and class of the words of a half."""
        out = np.zeros((CLASSES + 1) ** 2)
        for r in after.filter(f"half = {half} and words is null").select(F.posexplode("pairs")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
            out[r["pos"]] = r["n"]
        return out.reshape(CLASSES + 1, CLASSES + 1)

    def one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names, n, own in zip(batch["words"], batch["n"], batch["class"], strict=True):
                yield pd.DataFrame({"word": pd.Series([w.decode("utf-8", "replace") for w in names.split()], dtype=object), "n": unpacked(n, np.int64), "class": unpacked(own, np.uint8).astype(np.int32)})

    likelihood = lambda m: float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum())
    start = cut(found.mapInPandas(first, schema))
    now, held, turn, low = [start, start], [counted(start, 0), counted(start, 1)], 0, 0
    while low < 2:  # both halves have had their turn to no gain
        half = turn % 2
        after = cut(now[half].filter(f"half = {half} and words is not null").mapInPandas(moving(half, pairs), schema))
        fresh = counted(after, half)
        better = pairs - held[half] + fresh
        rise = likelihood(better) - likelihood(pairs)
        low = 0 if rise > TOLERANCE * abs(likelihood(pairs)) else low + 1
        turn += 1
        if rise <= 0:  # moves that don't go together
            forget(after)
            continue
        if now[half] is not start:
            forget(now[half])
        now[half], pairs, held[half] = after, better, fresh
    halves = [now[h].filter(f"half = {h}") for h in range(2)] + [start.filter("half = 2")]
    kept = halves[0].unionByName(halves[1]).unionByName(halves[2]).filter("words is not null").select("words", "n", "class")
    return kept.mapInPandas(one_by_one, "word string, n long, class int"), pairs


def train(shards: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training texts of number_texts(), and their words as (word, n, class); null texts count as empty."""
    frequent = frequent_words(shards)
    found = cut(context_blocks(shards, frequent))
    bigrams, kinds = unit_bigrams(found, frequent)
    class_of = exchange(bigrams)
    classes, pairs = refine(found, frequent, class_of, bigrams)
    classes = cut(classes)
    forget(found)
    ends = int(bigrams[:, END].sum())
    distinct = np.zeros(CLASSES + 1)
    for r in classes.groupBy("class").agg(F.count("*").alias("kinds")).collect():
        distinct[r["class"]] = r["kinds"]
    distinct[CLASSES] = ends > 0
    units = {w: u for u, w in enumerate(frequent)}
    top = classes.join(F.broadcast(classes.sparkSession.createDataFrame([(w.decode(),) for w in frequent], "word string")), "word").collect()
    transition = np.log10((pairs + ADD_TRANSITION) / (pairs.sum(1, keepdims=True) + ADD_TRANSITION * (CLASSES + 1)))
    denominator = pairs.sum(0) + ADD_WORD * (distinct + 1)
    known = {r["word"].encode(): (units[r["word"].encode()], r["n"], r["class"]) for r in top}
    return Model(int(pairs.sum()), int(kinds.sum()), ends, known, class_of, transition, denominator), classes


def _scorer(model: Model, buckets: int):
    base_total = model.tokens + model.distinct + 1

    def score(shard: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys, out = [], []
        for r, (_, found, _, texts, _) in zip(shard.itertuples(index=False), _shards(iter([shard])), strict=True):
            unit = np.array([*model.units(found), END], np.int64)
            before = model.context[unit]
            c, k = np.zeros(len(found) + 1), before.copy()
            order, there, ends = _dealt(found, buckets)
            of_bucket = dict(zip(answers["bucket"], answers["answer"], strict=True))
            for bucket, a, b in zip(there, ends, ends[1:]):
                answer = unpacked(of_bucket[bucket], np.int64)
                at, known = order[a:b], answer > 0
                c[at] = answer >> 7
                k[at[known]] = answer[known] & 127
            c[-1] = model.ends
            base = np.log10((c + 1) / base_total)
            emit = np.log10((c + ADD_WORD) / model.denominator[k])
            end = np.array([len(found)], np.int32)
            path = np.concatenate([end, *(x for ids in texts for x in (ids, end))])
            n_tokens = np.array([len(ids) + 1 for ids in texts], np.int64)
            starts, to = np.cumsum(n_tokens) - n_tokens, path[1:]
            by_text = lambda x: np.add.reduceat(x, starts)
            n_known, scores = by_text((c > 0).astype(np.int64)[to]), by_text(emit[to] + model.transition.ravel()[(before * (CLASSES + 1))[path[:-1]] + k[to]])
            out.append(pd.DataFrame({"n_tokens": n_tokens, "n_known": n_known, "base_score": by_text(base[to]), "score": scores}))
            keys += list(r.keys)
        return pd.concat([pd.DataFrame({"row": keys}, dtype=object), pd.concat(out, ignore_index=True)], axis=1)

    return score


def score_texts(shards: DataFrame, key: str, model: Model, classes: DataFrame) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score): a row for each text of number_texts().

    Null and empty texts are their end alone. base_score is by add-one unigrams, score the class model's log10 probability;
    10 ** (-score / n_tokens) is the perplexity. Repeated rows score alike; null keys stay null; no texts give no rows.
    """
    buckets = _buckets(shards.sparkSession)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, words_ in zip(batch["shard"], batch["words"], strict=True):
                names = words_.split()
                order, of, ends = _dealt(names, buckets)
                names = _named(names, order)
                yield pd.DataFrame({"at": [at] * len(of), "bucket": of, "words": [b" ".join(names[a:b]) for a, b in zip(ends, ends[1:])]})

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        # 7 bits for the class, the rest for the count; 0 for a word without one
        held = dict(zip(known["word"], known["answer"].tolist(), strict=True))
        found = [packed(np.array([held.get(w, 0) for w in x.split()], np.int64)) for x in asked["words"]]
        return pd.DataFrame({"at": asked["at"], "bucket": asked["bucket"], "answer": found})

    asked = shards.select("shard", "words").mapInPandas(ask, "at long, bucket int, words binary")
    dealt = classes.select((F.crc32("word") % buckets).cast("int").alias("bucket"), F.encode("word", "UTF-8").alias("word"), F.shiftleft("n", 7).bitwiseOR(F.col("class").cast("long")).alias("answer"))
    answers = asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(answer, "at long, bucket int, answer binary")
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    scored = shards.groupBy("shard").cogroup(answers.groupBy("at")).applyInPandas(_scorer(model, buckets), f"row {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumnRenamed("row", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    shards = cut(number_texts(docs, "doc_id", "text", ~held_out))
    model, classes = train(shards)
    scored = score_texts(shards, "doc_id", model, classes)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
