"""Near-duplicates by SimHash over word shingles, verified by Jaccard similarity (the pipeline's near-dedup stage).

Texts whose sets of distinct shingles have a similarity of ``SIMILARITY`` or more are linked, and classes are what links join. Candidates come from SimHash: a
shingle's hash gives each of the fingerprint's bits a weight from -255 to 255, and a bit is set if its sum over the text's shingles is above 0. (Weights of one bit each would
tie in texts of few shingles.) Two sets of similarity 0.8 have a cosine of 8 / 9 or more, so they differ in 15 % of their bits: 10 of 64, far from the 3 that operator 3 links.

So the search is ball hashing that meets in the middle, as there, by ``BLOCKS`` blocks of ``BITS`` bits: a text emits each block as it is and with the ``WEAK`` bits whose sums are
nearest 0, those that edits turn first, flipped in all ways. The balls of two texts meet if every bit that differs in a block is weak in one of the two. At a similarity of 0.8 this has a chance
of 0.37 a block, so none of 24 meets with one of 2e-5. Texts that meet are linked if ``CHECKED`` other bits differ in ``NEAR_CHECKED`` at most. Links within a bucket are a tree for each
group of near fingerprints, never all pairs. Every candidate pair that could join two classes is verified on the whole sets, so no pair below SIMILARITY is linked.

Texts of equal sets are one node from the start. What links of fingerprints join is a block: no class leaves it. The sets of a block travel once, to one task, which grows the classes
in it: it asks for each node which of the nodes that are in no class yet have a near fingerprint and a fitting size, and which of those are alike, all of them in one step over their sets. A node that has a class is
never asked for again, so a group of copies that are alike costs about its sets. Nodes near one another that no link joins are still compared in pairs, by their fingerprints, a few by their sets; but pairs are never rows.
A block of more than BLOCK_NODES nodes or BLOCK_BYTES of sets is not held by one task; its buckets (the nodes that share a key) are searched in rounds instead: nodes are paired with the first few of their bucket, then with
those up to four times as many, and so on, pairs that links already join or whose fingerprints are not near left out, until no bucket has a pair that is neither looked at nor joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.common import cut, join_counted, split_by
from lectern.llm.components import components

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILARITY = (4, 5)
#: Blocks of a fingerprint, bits of each, and how many of these are flipped.
BLOCKS, BITS, WEAK = 24, 16, 2
#: Bits beside the blocks that texts which meet are compared by, and how many may differ: of two sets of similarity 0.8, 2 pairs in 100,000 differ in more, as do all but one pair in a million of unlike ones.
CHECKED, NEAR_CHECKED = 128, 37
#: Bits of all that may differ: of two sets of similarity 0.8, 5 pairs in a million differ in more.
NEAR = 115
#: First bits of a block by which its keys are dealt out: keys of a ball that agree in them travel as one record.
SLOT_BITS = 6
#: Nodes of a bucket up to which all are compared at once, and from which they are linked without a look.
ONCE, HOT = 64, 50_000
#: Nodes of a bucket up to which all pairs are verified at once, the first nodes taken in larger ones, and the growth of their number.
SMALL, LEADERS, GROWTH = 8, 2, 4
#: Nodes and bytes of shingles of a block that one task holds.
BLOCK_NODES, BLOCK_BYTES = 5000, 64 << 20
#: Shingles whose weights are summed at a time: so many bytes fit 16 bits.
CHUNK = 256

_RANDOM = np.random.default_rng(42)
_ADD = _RANDOM.integers(0, 2**64, (BLOCKS * BITS + CHECKED) // 8, np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, len(_ADD), np.uint64) | np.uint64(1)
_EVEN = np.uint64(0x00FF00FF00FF00FF)
#: 16-bit words of a fingerprint that hold bits; after them come the weak bits of each block.
WORDS = BLOCKS + CHECKED // 16


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "replace").translate(simhash._LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    lows, highs = np.concatenate([[0], ends[:-1] + 1])[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], simhash.SEED) for a, b in zip(lows, highs, strict=True)), np.uint64, n))


def weights(found: np.ndarray) -> np.ndarray:
    """The sums of a set's weights, one a bit: each hash gives a byte, twice of which less 255 is the weight."""
    out = np.zeros((len(_ADD), 8), np.int64)
    for i in range(0, len(found), CHUNK):
        x = (found[i : i + CHUNK, None] ^ _ADD) * _TIMES
        x ^= x >> np.uint64(32)
        out[:, 0::2] += (x & _EVEN).sum(0).view(np.uint16).reshape(-1, 4)
        out[:, 1::2] += ((x >> np.uint64(8)) & _EVEN).sum(0).view(np.uint16).reshape(-1, 4)
    return 2 * out.ravel() - 255 * len(found)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes in 16-bit words, the blocks first, and the WEAK bits of each block; all 0 for the empty set."""
    if not len(found):
        return np.zeros(WORDS + BLOCKS, np.uint16)
    sums = weights(found)
    blocks = np.abs(sums[: BLOCKS * BITS]).reshape(BLOCKS, BITS)
    weak = np.zeros((BLOCKS, BITS), bool)
    np.put_along_axis(weak, np.argsort(blocks, 1, kind="stable")[:, :WEAK], True, 1)
    return np.packbits(np.concatenate([sums > 0, weak.ravel()])).view(np.uint16)


#: What a node has in a slot: a block and its weak bits, of which the slot's keys are made, and the bits by which texts that meet are compared.
_RECORD = np.dtype([("block", "<u2"), ("weak", "<u2"), ("node", "<i8"), ("check", "<i8"), ("check2", "<i8")])
#: Bits of a block that don't tell its slot.
_INSIDE = BITS - SLOT_BITS


def _flips(weak: np.ndarray) -> list[np.ndarray]:
    """The weak bits in all ways."""
    flips = [np.zeros_like(weak)]
    for _ in range(WEAK):
        low = weak & (~weak + np.uint16(1))
        flips += [f | low for f in flips]
        weak = weak ^ low
    return flips


def keys(prints: np.ndarray) -> np.ndarray:
    """The keys of fingerprints' balls, a row each: every block with its weak bits flipped in all ways, the block's number above them."""
    blocks, number = prints[..., :BLOCKS], np.arange(BLOCKS, dtype=np.int32) << BITS
    return np.concatenate([number | (blocks ^ f).astype(np.int32) for f in _flips(prints[..., WORDS:])], -1)


#: A fingerprint and its keys by the names that tests know.
minima = fingerprint


def bands(found: np.ndarray) -> list[int]:
    return keys(found).tolist() if found.any() else []


def _marks(text: Column, shingle: int, sets: bool = False) -> Column:
    """(node, fingerprint, number of shingles) of texts, with their shingles if asked for."""

    @F.pandas_udf("node long, fingerprint binary, size long" + ", shingles binary" * sets)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found = [shingles(t, shingle) for t in series]
            out = pd.DataFrame({
                "node": pd.Series([simhash._signed(xxhash.xxh64_intdigest(s.tobytes())) for s in found], dtype="int64"),
                "fingerprint": pd.Series([fingerprint(s).tobytes() for s in found], dtype=object), "size": pd.Series([len(s) for s in found], dtype="int64"),
            })
            yield out.assign(shingles=pd.Series([s.tobytes() for s in found], dtype=object)) if sets else out

    # so called lest a filter on its result move it before a join
    return of.asNondeterministic()(text)


def _balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, node, check, check2) for the keys of each node(node, fingerprint); texts without words have none."""
    for batch in batches:
        for a in range(0, len(batch), 1000):
            part = batch.iloc[a : a + 1000]
            prints = np.frombuffer(b"".join(part["fingerprint"]), np.uint16).reshape(-1, WORDS + BLOCKS)
            some = prints.any(1)
            prints, nodes = prints[some], part["node"].to_numpy(np.int64)[some]
            found = keys(prints)
            checks = np.ascontiguousarray(prints[:, BLOCKS:WORDS]).view(np.int64)
            each = found.shape[1]
            yield pd.DataFrame({"key": found.ravel(), "node": nodes.repeat(each), "check": checks[:, 0].repeat(each), "check2": checks[:, 1].repeat(each)})


def _least(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least that links join with each of n."""
    label = np.arange(n)
    while (label[low] != label[high]).any():
        least = np.minimum(label[low], label[high])
        np.minimum.at(label, low, least)
        np.minimum.at(label, high, least)
        label = label[label]
    return label


def slot_links(slot: int, records: list[bytes]) -> pd.DataFrame:
    """bucket_links() of all buckets of a slot, what they join linked once: each node to the least one."""
    links = bucket_links(*entries(slot, records))
    nodes, at = np.unique(np.concatenate([links["u"], links["v"]]), return_inverse=True)
    label = _least(len(nodes), *np.split(at, 2))
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[linked], "v": nodes[label[linked]]})


def bucket_links(key: np.ndarray, node: np.ndarray, check: np.ndarray, check2: np.ndarray) -> pd.DataFrame:
    """Links (u, v) that join all nodes of a bucket whose checked bits are near, directly or by way of others; keys are sorted and whole."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    end, many = np.repeat(first + size, size), np.repeat(size, size)
    check, check2 = check.view(np.uint64), check2.view(np.uint64)
    near = lambda i, j: np.bitwise_count(check[i] ^ check[j]) + np.bitwise_count(check2[i] ^ check2[j]) <= NEAR_CHECKED
    low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = np.flatnonzero(many <= ONCE)
    for d in range(1, ONCE):
        at = at[at + d < end[at]]
        if not len(at):
            break
        hit = at[near(at, at + d)]
        low.append(hit), high.append(hit + d)
    low, high = np.concatenate(low), np.concatenate(high)
    label = _least(len(key), low, high)
    for a, m in zip(first[size > ONCE].tolist(), size[size > ONCE].tolist(), strict=True):
        if m > HOT:
            label[a : a + m] = a
            continue
        free = np.arange(a, a + m)
        while len(free):
            start, free, todo = free[0], free[1:], [free[0]]
            while todo and len(free):
                hit = near(free, todo.pop())
                label[free[hit]] = start
                todo += free[hit].tolist()
                free = free[~hit]
    linked = np.flatnonzero(label != np.arange(len(key)))
    return pd.DataFrame({"u": node[linked], "v": node[label[linked]]})


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(slot, records): the _RECORDs of a batch of node(node, fingerprint), a row a slot, so that their size doesn't depend on the number of partitions; texts without words have none."""
    for batch in batches:
        prints = np.frombuffer(b"".join(batch["fingerprint"]), np.uint16).reshape(-1, WORDS + BLOCKS)
        some = prints.any(1)
        prints, nodes = prints[some], batch["node"].to_numpy(np.int64)[some]
        checks = np.ascontiguousarray(prints[:, BLOCKS:WORDS]).view(np.int64)
        blocks, weak = prints[:, :BLOCKS], prints[:, WORDS:]
        # of keys in one slot, the one without a flip inside it stands for all
        sent = [(*np.nonzero((f & (2**_INSIDE - 1)) == 0), f) for f in _flips(weak)]
        slot = np.concatenate([at << SLOT_BITS | (blocks[i, at] ^ f[i, at]) >> _INSIDE for i, at, f in sent])
        node, block = np.concatenate([i for i, _, _ in sent]), np.concatenate([at for _, at, _ in sent])
        order = np.argsort(slot, kind="stable")
        slot, node, block = slot[order], node[order], block[order]
        held = np.empty(len(slot), _RECORD)
        held["block"], held["weak"], held["node"], held["check"], held["check2"] = blocks[node, block], weak[node, block], nodes[node], checks[node, 0], checks[node, 1]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.empty(0, np.int64)
        ends = np.append(first, len(slot))[1:]
        yield pd.DataFrame({"slot": slot[first].astype(np.int32), "records": pd.Series([held[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], dtype=object)})


def entries(slot: int, records: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, node, check and check2 of a slot's keys, sorted by key and node: so the root of a bucket's tree is its least node, and buckets of a group of near copies have few roots."""
    held = np.frombuffer(b"".join(records), _RECORD)
    found = [held["block"] ^ f for f in _flips(held["weak"])]
    inside = [np.flatnonzero(k >> _INSIDE == slot & (2**SLOT_BITS - 1)) for k in found]
    key, held = np.concatenate([k[i] for k, i in zip(found, inside, strict=True)]).astype(np.int64), held[np.concatenate(inside)]
    order = np.lexsort((held["node"], key))
    return key[order], *(held[c][order] for c in ("node", "check", "check2"))


def _linker(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the buckets of a partition's slots; it is sorted by slot, and a slot that goes on in the next batch waits for it."""
    at, waiting = -1, []
    for batch in batches:
        for slot, records in zip(batch["slot"].tolist(), batch["records"], strict=True):
            if slot != at and waiting:
                yield slot_links(at, waiting)
                waiting = []
            at = slot
            waiting.append(records)
    if waiting:
        yield slot_links(at, waiting)


def _alike(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            few, many = sorted((len(x), len(y)))
            shared = len(np.intersect1d(x, y, assume_unique=True)) if SIMILARITY[1] * few >= SIMILARITY[0] * many else 0
            out.append(SIMILARITY[1] * shared >= SIMILARITY[0] * (few + many - shared))
        return pd.Series(out, dtype=bool)

    return of(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(u, v) of SIMILARITY or more."""
    first = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    return first.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").filter(_alike(F.col("a"), F.col("b"))).select("u", "v")


def _sets(docs: DataFrame, marked: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, block, fingerprint, shingles) of nodes(node, block), made from the text of one document of each: shingles take twice the room of texts, and most nodes need none."""
    chosen = cut(marked.groupBy("node").agg(F.min(F.struct("name", "key")).alias("of")).join(nodes, "node").select("node", "block", "of.name"))
    asked, _ = split_by(docs, "name", chosen.select("name"))
    # names hold a hash only; repeated rows give one set
    texts = asked.join(chosen, "name").groupBy("name", F.md5("text").alias("digest")).agg(*[F.first(c).alias(c) for c in ("node", "block", "text")])
    return texts.select("node", "block", _marks(F.col("text"), shingle, sets=True).alias("s")).filter("node = s.node").select("node", "block", "s.fingerprint", "s.shingles")


def grown(block: pd.DataFrame) -> pd.DataFrame:
    """(node, component) of a block(node, fingerprint, shingles): the classes of its nodes by their least node; nodes that are alone are left out."""
    block = block.rename(columns={"minima": "fingerprint"}).drop_duplicates("node").sort_values("node", ignore_index=True)
    nodes, sets = block["node"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in block["shingles"]]
    sizes, label = np.array([len(x) for x in sets]), np.full(len(nodes), -1)
    bits = np.stack([np.frombuffer(x, np.uint64, WORDS // 4) for x in block["fingerprint"]])
    # nodes that have a class are never looked at again
    free, is_free = np.arange(len(nodes)), np.ones(len(nodes), bool)
    while len(free):
        start, free = free[0], free[1:]
        todo = [start]
        while todo and len(free):
            u = todo.pop()
            near = free[np.bitwise_count(bits[free] ^ bits[u]).sum(1) <= NEAR]
            near = near[(SIMILARITY[1] * np.minimum(sizes[near], sizes[u])) >= SIMILARITY[0] * np.maximum(sizes[near], sizes[u])]
            if not len(near):
                continue
            flat = np.concatenate([sets[i] for i in near])
            hit = sets[u][np.minimum(np.searchsorted(sets[u], flat), sizes[u] - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            alike = near[SIMILARITY[1] * both >= SIMILARITY[0] * (sizes[near] + sizes[u] - both)]
            label[alike] = label[start] = start
            is_free[alike] = False
            free = free[is_free[free]]
            todo += alike.tolist()
    some = label >= 0
    return pd.DataFrame({"node": nodes[some], "component": nodes[label[some]]})


def link(docs: DataFrame, marked: DataFrame, distinct: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, component): the classes of nodes that links join, from docs(name, text), marked(name, key, node) and distinct(node, fingerprint, size); nodes without a link are not in it."""
    records = distinct.select("node", "fingerprint").mapInPandas(_records, "slot int, records binary")
    linked = components(records.repartition("slot").sortWithinPartitions("slot").mapInPandas(_linker, "u long, v long"))
    blocks = cut(linked.join(distinct.select("node", "size"), "node").select("node", F.col("component").alias("block"), "size"))
    fits = (F.count("*") <= BLOCK_NODES) & (8 * F.sum("size") <= BLOCK_BYTES)
    large = cut(blocks.groupBy("block").agg(fits.alias("fits")).filter("not fits").select("block"))
    if large.isEmpty():
        return cut(_sets(docs, marked, blocks, shingle).groupBy("block").applyInPandas(grown, "node long, component long"))
    small = blocks.join(F.broadcast(large), "block", "left_anti")
    whole = cut(_sets(docs, marked, small, shingle).groupBy("block").applyInPandas(grown, "node long, component long"))
    sets = cut(_sets(docs, marked, blocks.join(F.broadcast(large), "block", "left_semi"), shingle))
    members = cut(sets.select("node", "fingerprint").mapInPandas(_balls, "key int, node long, check long, check2 long").withColumnRenamed("key", "band"))
    shared = members.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    return whole.union(_rounds(members.join(shared, "band"), sets.select("node", "shingles")))


def _rounds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """link()'s classes for members(node, band, m, check, check2) of blocks that no task holds."""
    bucket = W.partitionBy("band")
    members = cut(members.withColumn("rank", F.row_number().over(bucket.orderBy("node")) - 1).withColumn("label", F.col("node")))
    classes, start, end = None, 0, LEADERS
    while True:
        leads = members.filter((F.col("rank") >= start) & ((F.col("rank") < end) | (F.col("m") <= SMALL)))
        leads = leads.select("band", F.col("rank").alias("first"), F.col("node").alias("u"), F.col("label").alias("with"), F.col("check").alias("a"), F.col("check2").alias("b"))
        near = f"bit_count(a ^ check) + bit_count(b ^ check2) <= {NEAR_CHECKED}"
        pairs = leads.join(members, "band").filter(f"rank > first and label <> with and {near}").select("u", F.col("node").alias("v")).distinct()
        found = cut(_verified(pairs, sets))
        # classes so far stand for the links that made them: one row a node, however many pairs were verified
        classes = components(found if classes is None else found.union(classes.select("node", "component")))
        labelled = members.filter((F.col("m") > SMALL) & (F.col("m") > end + 1)).drop("label").join(classes.withColumnRenamed("component", "label"), "node", "left")
        labelled = labelled.withColumn("label", F.coalesce("label", "node"))
        # buckets that links join as a whole are done
        open_ = labelled.withColumns({"low": F.min("label").over(bucket), "high": F.max("label").over(bucket)}).filter("low <> high")
        members = cut(open_.select("node", "band", "m", "rank", "label", "check", "check2"))
        if members.isEmpty():
            return classes
        start, end = end, end * GROWTH


def near_duplicates(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, node long, component): a row for each row of docs, component being the least key of its class.

    Null and empty texts are one node; null keys never name a class unless it has no other. Repeated rows are kept. An
    empty table gives no rows.
    """
    # key and hash of the text, so that rows of one key, or of none, are told apart
    name = F.concat_ws("|", F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.col(key).cast("string"))
    named_docs = docs.select(F.col(key).alias("key"), name.alias("name"), F.col(text).alias("text"))
    marked = cut(named_docs.select("key", "name", _marks(F.col("text"), shingle).alias("s")).select("key", "name", "s.node", "s.fingerprint", "s.size"))
    distinct = cut(marked.groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("__n"), F.first("fingerprint").alias("fingerprint"), F.first("size").alias("size")))
    total = distinct.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    named = cut(distinct.join(link(named_docs.select("name", "text"), marked, distinct, shingle), "node", "left").select("node", "least", "__n", F.coalesce("component", "node").alias("label")))
    classes = named.groupBy("label").agg(F.min("least").alias("component"))
    return join_counted(marked.select("key", "node"), named.join(classes, "label").select("node", "__n", "component"), "node", total).select(F.col("key").alias(key), "node", "component")


def keep_one(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each class: that with the least key; of equal rows with that key, one."""
    return simhash.keep_least(docs, key, near_duplicates(docs, key, text, shingle))
