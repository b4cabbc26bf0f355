"""Many needles in the pages of their documents at once.

The needles of a document make up one Aho-Corasick automaton, and each page is read once with it: the cost grows with the text and the matches, not with needles
times pages. Documents are dealt out in parts of PART_PAGES pages and slices of SLICE_NEEDLES needles, so a document
with most of all pages or needles is no single task; a task streams through its pages and holds one automaton. Pages and needles are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.sources.tables import stored

#: Pages and distinct needles of a document that meet in one place.
PART_PAGES, SLICE_NEEDLES = 256, 20_000
#: Documents of a table up to which it is broadcast.
FEW_DOCUMENTS = 200_000


def few(docs: DataFrame) -> bool:
    return docs.limit(FEW_DOCUMENTS + 1).count() <= FEW_DOCUMENTS


def occurrences(needles: DataFrame, texts: DataFrame, key: str = "needle", first: bool = False, cheap: bool = False) -> DataFrame:
    """(doc_id, key, page): the pages of texts(doc_id, page, text) that hold a needle(doc_id, needle[, key]) of their document, as they are written.

    Empty and null needles and texts are found nowhere, nor do rows without a document meet. Repeated rows of either side give one row. Pages may be
    null, and are then one page. key: a unique column that stands for the needle in the result, so that needles don't travel back. first: of the pages of a
    needle only the first in each part of its document. cheap: both sides are read several times as they are; else they are written once.
    """
    c = F.col
    wanted = needles.filter("doc_id is not null and needle <> ''").select(*dict.fromkeys(["doc_id", key, "needle"]))
    part = F.floor(F.coalesce(c("page"), F.lit(0)) / PART_PAGES).cast("long").alias("part")
    pages = texts.filter("doc_id is not null and text <> ''").select("doc_id", "page", "text", part)
    if not cheap:
        wanted, pages = stored(wanted.distinct()), stored(pages)
    asked = wanted.select("doc_id").distinct()
    # of many documents all pages travel, rather than twice
    read = pages.join(F.broadcast(asked), "doc_id", "left_semi") if few(asked) else pages
    # documents with more needles than a slice has, and those with pages beyond the first part
    wide = wanted.groupBy("doc_id").agg(F.ceil(F.count("*") / SLICE_NEEDLES).cast("int").alias("slices")).filter("slices > 1")
    far = (texts.select("doc_id", part) if cheap else pages).filter("doc_id is not null and part <> 0").groupBy("doc_id").agg(F.collect_set("part").alias("parts"))
    far = F.broadcast(far) if few(far) else far
    # a page meets each slice of its document's needles, a needle each part of the pages
    slices = F.coalesce("slices", F.lit(1))
    dealt_pages = read.join(F.broadcast(wide), "doc_id", "left").select("doc_id", "part", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), *[F.lit(None).cast(wanted.schema[k].dataType).alias(k) for k in wanted.columns[1:]], "page", "text")
    none = [F.lit(None).cast(pages.schema[k].dataType).alias(k) for k in ("page", "text")]
    parts = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("parts", F.expr("cast(array() as array<bigint>)")))
    dealt_needles = wanted.join(F.broadcast(wide), "doc_id", "left").join(far, "doc_id", "left").select("doc_id", F.explode(parts).alias("part"), F.pmod(F.xxhash64("needle"), slices).cast("int").alias("slice"), *wanted.columns[1:], *none)
    order = [c("needle").asc_nulls_last(), c("page").asc_nulls_last()]
    together = dealt_needles.union(dealt_pages).repartition("doc_id", "part", "slice").sortWithinPartitions("doc_id", "part", "slice", *order)
    schema = StructType([together.schema["doc_id"], together.schema[key], together.schema["page"]])
    return together.mapInArrow(_scanner(key, first), schema)


def _scanner(key: str, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches):
        """Needles come before the pages that they are looked for in, and these in their order: rows of one page follow one another."""
        import ahocorasick

        at, machine, keys, ready, done, last = None, None, {}, False, set(), None
        for batch in batches:
            docs, words, pages = [], [], []
            for doc, part, slice_, k, needle, page, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "slice", key, "needle", "page", "text")), strict=True):
                if (doc, part, slice_) != at:
                    at, machine, keys, ready, done, last = (doc, part, slice_), ahocorasick.Automaton(), {}, False, set(), None
                if needle is not None:
                    if needle not in keys:
                        machine.add_word(needle, needle)
                        keys[needle] = [k]
                    elif key != "needle":
                        keys[needle].append(k)
                    continue
                if not keys:
                    continue
                if not ready:
                    machine.make_automaton()
                    ready = True
                if not first and (page,) != last:
                    done, last = set(), (page,)
                found = {word for _, word in machine.iter(text)} - done
                done |= found
                for word in found:
                    docs += [doc] * len(keys[word])
                    words += keys[word]
                    pages += [page] * len(keys[word])
            types = [batch.schema.field(c).type for c in ("doc_id", key, "page")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((docs, words, pages), types, strict=True)], names=["doc_id", key, "page"])

    return scan
