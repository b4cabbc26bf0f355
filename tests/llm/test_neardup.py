import random

import pytest

import corpus_pipeline
from lectern.llm import neardup


def plain_set(text, k=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_kept(texts):
    """The least id of each class, all pairs compared."""
    sets, root = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and root[i] != root[j] and alike(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"new{rnd.random()}"
    return out


@pytest.mark.parametrize("block", [5000, 20])
def test_stage_against_all_pairs(spark, monkeypatch, block):
    """Also with blocks that are too large for one task."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", block)
    rnd = random.Random(5)
    texts, i = {}, 0
    for _ in range(40):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(100, 300))]
        for n in (0, 1, 2, 3, 4, 5, 6):
            texts[i] = " ".join(edited(rnd, base, n))
            i += 1
    # a large group, most of whose pairs are below 0.8 but near it
    base = [f"h{k}" for k in range(200)]
    for _ in range(60):
        texts[i] = " ".join(edited(rnd, base, rnd.randint(2, 9)))
        i += 1
    texts |= {i: None, i + 1: "", i + 2: "two words", i + 3: "Two  words"}
    docs = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()}
    assert kept == plain_kept(texts)


def test_similar_below_the_limit_is_kept(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    # a replaced last word makes one shingle differ; of 100, 11 replaced at the end leave 89 / 111 >= 0.8, 12 leave 88 / 112 < 0.8
    texts = {1: base, 2: base[:-11] + [f"x{k}" for k in range(11)], 11: ["y", *base], 12: ["y", *base[:-12], *[f"z{k}" for k in range(12)]]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs, "doc_id", "text").collect()) == sorted(plain_kept({k: " ".join(t) for k, t in texts.items()}))
    assert neardup.keep_one(docs.limit(0), "doc_id", "text").count() == 0


def test_texts_without_a_key(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base + " x"), (None, "something else that stands apart from all of them"), (3, base + " y"), (3, "and one more that is like none of the others here")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert len(found) == 5 and sum(r["component"] == 3 for r in found) == 4


def test_comparisons_in_a_hot_group(monkeypatch):
    """Sets compared in a group of near copies: a small part of its pairs, where most are alike and where few are."""
    import numpy as np
    import pandas as pd

    def asked(n, low, high):
        rnd = random.Random(12)
        base = [f"h{k}" for k in range(200)]
        found = [neardup.shingles(" ".join(edited(rnd, base, rnd.randint(low, high)))) for _ in range(n)]
        lows = [neardup.minima(s) for s in found]
        block = pd.DataFrame({"node": np.arange(n), "bands": [neardup.bands(x) for x in lows], "minima": [x.astype(np.uint16).tobytes() for x in lows], "shingles": [s.tobytes() for s in found]})
        seen, real = [0], np.searchsorted
        monkeypatch.setattr(np, "searchsorted", lambda a, v: (seen.__setitem__(0, seen[0] + len(v)), real(a, v))[1])
        neardup.grown(block)
        monkeypatch.setattr(np, "searchsorted", real)
        return seen[0] / 196

    assert asked(800, 1, 3) < 0.1 * 800 * 799 / 2
    assert asked(800, 4, 9) < 0.45 * 800 * 799 / 2


def test_candidates_come_from_simhash(spark):
    """Fingerprints are SimHash: bits of summed weights, whose differences follow the angle; pairs at the limit of the similarity meet, short ones too, as do buckets of any size."""
    import numpy as np

    rnd = np.random.default_rng(3)
    found, different = rnd.integers(0, 2**64, 300, np.uint64), []
    parts = sum(neardup.weights(found[i : i + 1]) for i in range(300))
    assert (neardup.weights(found) == parts).all() and abs(parts).max() < 300 * 256
    bits = np.unpackbits(neardup.fingerprint(found)[: neardup.WORDS].view(np.uint8))
    assert (bits == (parts > 0)).all() and not neardup.fingerprint(found[:0]).any() and neardup.bands(neardup.fingerprint(found[:0])) == []
    for n in [5] * 100 + [10] * 100 + [100] * 100:
        union = rnd.integers(0, 2**64, n, np.uint64)
        a, b = (neardup.fingerprint(x) for x in (union[: -n // 10 or -1], np.concatenate([union[: n * 4 // 5], union[n - n // 10 :]])))
        assert set(neardup.bands(a)) & set(neardup.bands(b))
        different.append(int(np.bitwise_count(a[: neardup.WORDS] ^ b[: neardup.WORDS]).sum()))
    assert max(different) <= neardup.NEAR and abs(np.mean(different[200:]) - 512 * np.arccos(8 / 9) / np.pi) < 3
    # near fingerprints of a bucket are one tree, whatever their number; others have no link
    for copies in (30, 300):
        check, check2 = (np.concatenate([np.full(copies, -5), rnd.integers(-(2**63), 2**63, 40)]) for _ in range(2))
        key, node = np.full(len(check), 7), np.arange(len(check))
        links = neardup.bucket_links(key, node, check, check2)
        assert sorted(links["u"]) == list(range(1, copies)) and set(links["v"]) == {0}
    assert not len(neardup.bucket_links(np.arange(9), np.arange(9), np.zeros(9, np.int64), np.zeros(9, np.int64)))


def test_near_copies_have_few_roots(spark, monkeypatch):
    """The links of a group of near copies stay well below one for each node and key (96): a slot's trees start from their least nodes, and a slot has one link a node."""
    rnd, asked, real = random.Random(4), [], neardup.components
    base = [f"h{k}" for k in range(200)]
    docs = spark.createDataFrame([(i, " ".join(edited(rnd, base, rnd.randint(0, 4)))) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(neardup, "components", lambda links: (asked.append(links.distinct().count()), real(links))[1])
    found = neardup.near_duplicates(docs, "doc_id", "text").collect()
    assert len(found) == 400 and {r["component"] for r in found} == {0}
    assert len(asked) == 1 and 399 <= asked[0] < 20 * len({r["node"] for r in found})


def test_records_give_the_keys_of_the_balls():
    """Every key of a ball is in one slot once, and a record costs the same in any partitioning."""
    import numpy as np
    import pandas as pd

    rnd = np.random.default_rng(8)
    prints = [neardup.fingerprint(rnd.integers(0, 2**64, 40, np.uint64)) for _ in range(50)] + [neardup.fingerprint(np.empty(0, np.uint64))]
    rows = next(neardup._records(iter([pd.DataFrame({"node": np.arange(51), "fingerprint": [x.tobytes() for x in prints]})])))
    assert rows["slot"].is_unique and sum(map(len, rows["records"])) < 50 * 1500
    found = []
    for slot, records in zip(rows["slot"], rows["records"], strict=True):
        key, node, check, _ = neardup.entries(slot, [records])
        assert (np.lexsort((node, key)) == np.arange(len(key))).all() and all(prints[n][neardup.BLOCKS :].view(np.int64)[0] == c for n, c in zip(node, check, strict=True))
        found += zip(((slot >> neardup.SLOT_BITS) << neardup.BITS | key).tolist(), node.tolist(), strict=True)
    assert sorted(found) == sorted((k, n) for n in range(50) for k in neardup.bands(prints[n]))


def test_rows_are_split_without_a_shuffle(spark):
    from lectern.llm.common import split_by

    rows = spark.createDataFrame([(str(i),) for i in range(3000)] + [(None,), ("7",)], "name string")
    some = rows.filter("cast(name as int) % 10 = 0").union(rows.limit(0))
    maybe, sure = (x.collect() for x in split_by(rows, "name", some))
    assert len(maybe) + len(sure) == 3002 and {str(i) for i in range(0, 3000, 10)} <= {r["name"] for r in maybe}
    assert len(maybe) < 300 + 2700 / 8 and (None,) in [tuple(r) for r in sure]
    none, every = split_by(rows, "name", rows.limit(0))
    assert none.count() == 0 and every.count() == 3002


def test_one_row_a_key_where_keys_repeat(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base), (1, base + " x"), (2, base + " y"), (3, "one that stands alone among them all"), (None, "no key and no copy of this"), (4, None), (5, "")]
    found = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, base), rows[4], rows[5], rows[6]], key=str)
