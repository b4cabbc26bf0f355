"""A Merkle manifest of a dataset, with a proof for every row, by pointer jumping (operator 13).

Leaves are digests of rows. The leaves of a tree (one a language) stand in the order of a key; every two neighbours become
their digest, one without a neighbour its own digest alone, until one node is left, the subroot. The subroots in order make up a tree
in the same way, whose last node is the root.

- Places are given by a range partitioning and sums of the ranges' sizes, not by one task a tree.
- Levels are made LEVELS at a time: 2^LEVELS neighbours meet in one group, however many rows a tree has.
- Proofs are made by pointer jumping. Every node holds a pointer to an ancestor and the segment of siblings on the way there, first to its
  parent. A self-join of nodes with the nodes that they point to doubles the distance and appends the segments; after round j only nodes at a multiple
  of 2^j levels are still needed as targets. A tree of n leaves takes log2(log2 n) joins. Rows that have arrived wait. A target is shared by 2^(2^j)
  nodes; where these are many there are few targets, and up to SMALL of them are broadcast, by their exact count.

A segment has 33 bytes a level: on which side the sibling is (or that there is none), and its digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import cut, forget, table

#: Levels that are made in one group, of 2^LEVELS nodes at most.
LEVELS = 10
#: Rows that may be broadcast; each has at most 64 x 33 bytes.
SMALL = 20_000
#: The columns of a leaf.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ALONE, LEFT, RIGHT = 0, 1, 2
WIDTH = 33


def digest(*parts: Column) -> Column:
    """SHA-256 as lower-case hex of all parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: each value with its length in bytes before it, so that no two rows run together; a null is a dash."""
    sized = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return digest(*[sized(v.cast("string")) for v in values])


def tree_key(value: Column) -> Column:
    """A tree's name as a string that is never null; names sort as the values do, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def places(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """A written table of rows with ``pos``, from 0 by tree in the order of the columns (nulls first), and ``size``, the rows of the tree.

    Rows equal in all these columns may change places with each other.
    """
    ordered = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last key parts equal rows, of which there may be more than a task can hold
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *ordered, "__tie").sortWithinPartitions(*ordered, "__tie")
    at = F.monotonically_increasing_id()
    numbered = cut(dealt.drop("__tie").withColumns({"__part": F.shiftright(at, 33).cast("int"), "__at": at.bitwiseAND(F.lit(2**33 - 1))}))
    counts = numbered.groupBy(tree, "__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    # a row for each range of a tree
    before = F.sum("n").over(W.partitionBy(tree).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(tree, "__part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy(tree)).alias("size"))
    placed = numbered.join(counts, [tree, "__part"]).withColumn("pos", F.col("__at") - F.col("first") + F.col("before")).drop("__part", "__at", "first", "before")
    out = cut(placed)
    forget(numbered)
    return out


def depth(size: Column) -> Column:
    """Levels above the leaves of a tree of so many."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _levels(nodes: Column, top: Column) -> Column:
    """array<struct<up, at, hash, side, sibling>> from the neighbours' digests: they and the nodes over them, ``top`` levels in all but the last; at counts from the group's first node of a level."""
    def step(state, up):
        now = state["now"]
        beside = lambda i: F.get(now, i.bitwiseXOR(F.lit(1)))
        level = F.transform(now, lambda h, i: F.struct(
            up.alias("up"), i.alias("at"), h.alias("hash"), F.when(beside(i).isNull(), ALONE).when(i % 2 == 0, RIGHT).otherwise(LEFT).alias("side"), beside(i).alias("sibling")))
        pairs = F.sequence(F.lit(0), ((F.size(now) + 1) / 2).cast("int") - 1)
        over = F.transform(pairs, lambda i: F.sha2(F.concat(F.get(now, i * 2), F.coalesce(F.get(now, i * 2 + 1), F.lit(""))), 256))
        return F.struct(over.alias("now"), F.concat(state["all"], level).alias("all"))

    none = F.expr("cast(array() as array<struct<up:int,at:int,hash:string,side:int,sibling:string>>)")
    steps = F.when(top > 0, F.sequence(F.lit(0), top - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, F.struct(nodes.alias("now"), none.alias("all")), step, lambda s: F.concat(s["all"], F.transform(s["now"], lambda h, i: F.struct(
        top.cast("int").alias("up"), i.alias("at"), h.alias("hash"), F.lit(ALONE).alias("side"), F.lit(None).cast("string").alias("sibling")))))


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of leaves(tree, pos, size, hash): nodes(tree, level, pos, top, segment) are all but the trees' last nodes, with the segment to the parent; roots(tree, hash, top)."""
    layer, base, nodes, roots, made = leaves.select("tree", "pos", depth(F.col("size")).cast("int").alias("top"), "hash"), 0, None, None, []
    while True:
        # neighbours meet in groups of a bounded size, whatever the tree's
        groups = layer.groupBy("tree", "top", F.shiftright("pos", LEVELS).alias("group")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("ns"))
        here = F.least(F.lit(LEVELS), F.col("top") - base)
        rows = groups.select("tree", "top", "group", F.explode(_levels(F.col("ns.hash"), here)).alias("x"))
        first = F.shiftleft("group", LEVELS)
        level = cut(rows.select("tree", "top", (F.col("x.up") + base).alias("level"), (F.expr(f"shiftright(shiftleft(group, {LEVELS}), x.up)") + F.col("x.at")).alias("pos"), "x.hash", "x.side", "x.sibling"))
        made.append(level)
        up = base + LEVELS
        inner = level.filter((F.col("level") < F.col("top")) & (F.col("level") < up))
        segment = F.concat(F.unhex(F.lpad(F.hex("side"), 2, "0")), F.unhex(F.coalesce("sibling", F.lit("0" * 64))))
        inner = inner.select("tree", "level", "pos", "top", segment.alias("segment"))
        last = level.filter(F.col("level") == F.col("top")).select("tree", "hash", "top")
        nodes, roots = (inner, last) if nodes is None else (nodes.union(inner), roots.union(last))
        layer = level.filter((F.col("level") == up) & (F.col("level") < F.col("top"))).select("tree", "pos", "top", "hash")
        base = up
        if layer.isEmpty():
            return nodes, roots


def prove(nodes: DataFrame) -> DataFrame:
    """(tree, pos, segment): the way from each leaf to its tree's last node, from build()'s nodes; a lone leaf has none and no row."""
    deepest = nodes.agg(F.max("top")).first()[0] or 0
    now, step = nodes, 1
    while step < deepest:
        # leaves move on; as targets of the next round nodes at a multiple of twice the step are needed
        ahead = F.least(F.col("level") + step, F.col("top"))
        moving = now.filter((F.col("level") % (2 * step) == 0) & (ahead < F.col("top")))
        done = now.filter((F.col("level") % (2 * step) == 0) & (ahead >= F.col("top")))
        targets = now.filter((F.col("level") % step == 0) & (F.col("level") > 0)).select("tree", F.col("level").alias("__level"), F.col("pos").alias("__pos"), F.col("segment").alias("__segment"))
        if targets.limit(SMALL + 1).count() <= SMALL:
            targets = F.broadcast(targets)
        pointed = moving.withColumns({"__level": F.col("level") + step, "__pos": F.expr(f"shiftright(pos, {step})")})
        jumped = pointed.join(targets, ["tree", "__level", "__pos"]).withColumn("segment", F.concat("segment", "__segment"))
        after = cut(jumped.select(*nodes.columns).union(done.select(*nodes.columns)))
        if now is not nodes:
            forget(now)
        now, step = after, step * 2
    return now.filter("level = 0").select("tree", "pos", "segment")


def _steps(segment: Column, of) -> Column:
    """of(side, sibling) for each level of a segment."""
    count = (F.octet_length(segment) / WIDTH).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    side = lambda i: F.conv(F.hex(F.substring(segment, i * WIDTH + 1, F.lit(1))), 16, 10).cast("int")
    return F.transform(at, lambda i: of(side(i), F.lower(F.hex(F.substring(segment, i * WIDTH + 2, F.lit(WIDTH - 1))))))


def proof_digest(segment: Column) -> Column:
    """The digest of a proof's siblings, in their order."""
    return F.sha2(F.array_join(_steps(segment, lambda side, sibling: F.when(side == ALONE, "").otherwise(sibling)), ""), 256)


def fold(start: Column, segment: Column) -> Column:
    """What a leaf and its siblings come to."""
    def step(h, s):
        return F.sha2(F.when(s["side"] == LEFT, F.concat(s["h"], h)).when(s["side"] == RIGHT, F.concat(h, s["h"])).otherwise(h), 256)

    return F.aggregate(_steps(segment, lambda side, sibling: F.struct(side.alias("side"), sibling.alias("h"))), start, step)


def manifest(rows: DataFrame, tree: str, order: Sequence[str], hash: str) -> DataFrame:
    """rows with ``subroot``, ``root`` and ``segment``, the siblings from the row's leaf ``hash`` to the root.

    tree and order may be null, which comes first. Rows with equal order are placed by their hash, and equal rows each have a leaf. An empty
    table gives no rows. rows must not have columns of these names, or named pos, size or tree.
    """
    placed = places(rows.withColumn("tree", tree_key(F.col(tree))), "tree", [*order, hash])
    nodes, roots = build(placed.select("tree", "pos", "size", F.col(hash).alias("hash")))
    within = prove(nodes)
    tops = places(roots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "hash"), "all", ["name"]).withColumnRenamed("all", "tree")
    top_nodes, top_root = build(tops)
    above = tops.join(prove(top_nodes), ["tree", "pos"], "left").join(top_root.select("tree", F.col("hash").alias("root")), "tree")
    # a row a tree
    above = above.select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", F.coalesce("segment", F.unhex(F.lit(""))).alias("__above"))
    proven = placed.join(within, ["tree", "pos"], "left").join(above, "tree")
    return proven.withColumn("segment", F.concat(F.coalesce("segment", F.unhex(F.lit(""))), "__above")).drop("tree", "pos", "size", "__above")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    tampered = [F.when(changed, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in COLUMNS]
    leaves = docs.select("doc_id", "lang", leaf(*map(F.col, COLUMNS)).alias("leaf"), leaf(*tampered).alias("now"))
    done = manifest(leaves, "lang", ["doc_id"], "leaf").withColumn("folded_root", fold(F.col("now"), F.col("segment")))
    return done.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("segment")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle() -> str:
    sized = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    row = lambda chars: f"sha256({' || '.join(sized(chars if c == 'n_chars' else c) for c in COLUMNS)})"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: {byte}), 4294967295)"
    levels = lambda name, leaves: f"""{name} AS (
  SELECT k, 0 AS level, pos, hash, n FROM {leaves}
  UNION ALL SELECT k, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), max(n) // 2 + max(n) % 2 FROM {name} WHERE n > 1 GROUP BY k, level, pos // 2
)"""  # noqa: E731
    way = lambda name, leaves, nodes: f"""{name} AS (
  SELECT l.k, l.pos, list(CASE WHEN s.hash IS NULL THEN 'A' WHEN s.pos % 2 = 1 THEN 'R' || s.hash ELSE 'L' || s.hash END ORDER BY t.level) AS steps
  FROM {leaves} l JOIN {nodes} t ON t.k = l.k AND t.pos = l.pos >> t.level AND t.n > 1 LEFT JOIN {nodes} s ON s.k = t.k AND s.level = t.level AND s.pos = xor(t.pos, 1) GROUP BY ALL
)"""  # noqa: E731
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, {row('n_chars')} AS leaf, {row(f'CASE WHEN {crc} % 7 = 0 THEN n_chars + 1 ELSE n_chars END')} AS now FROM documents
), leaves AS (
  SELECT *, leaf AS hash, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM docs
), {levels('nodes', 'leaves')}, tops AS (
  SELECT '' AS k, k AS name, hash, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), {levels('over', 'tops')}, {way('within', 'leaves', 'nodes')}, {way('above', 'tops', 'over')},
whole AS (
  SELECT l.*, t.hash AS subroot, (SELECT hash FROM over WHERE n = 1) AS root, coalesce(w.steps, []) || coalesce(a.steps, []) AS steps
  FROM leaves l JOIN tops t ON t.name = l.k LEFT JOIN within w ON w.k = l.k AND w.pos = l.pos LEFT JOIN above a ON a.pos = t.pos
), folded AS (
  SELECT *, list_reduce(list_prepend(now, steps), lambda h, s: sha256(CASE left(s, 1) WHEN 'L' THEN substr(s, 2) || h WHEN 'R' THEN h || substr(s, 2) ELSE h END)) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: substr(s, 2)), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
