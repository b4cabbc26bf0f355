"""Diverse units as targets of cites: greedy choice under two quotas at once, a section's and a parent's, and a second pass that fills up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a unit's kind and places count, how fast the place in the document fades, quotas, how many are chosen.
ABSTRACT, ANCHOR, ANCHOR_LENGTH, PAGE, SENTENCE, EARLY, FADE = 3.0, 2.0, 24, 1.0, 0.5, 0.5, 0.001
PER_SECTION, PER_PARENT, TARGETS = 2, 3, 12


def target_score(place: Column) -> Column:
    """What a unit counts as a target: abstracts, units with an anchor, a page and sentence numbers, a little more for early ones (place counts from 0)."""
    c = F.col
    when = lambda test, gain: F.when(test, gain).otherwise(0.0)
    return (
        when(c("kind") == "abstract", ABSTRACT) + when(F.coalesce(F.length("anchor_text"), F.lit(0)) >= ANCHOR_LENGTH, ANCHOR) + when(c("page_start").isNotNull(), PAGE)
        + when(c("sent_start").isNotNull(), SENTENCE) + F.greatest(F.lit(0.0), EARLY - place * FADE)
    )


def select_targets(units: DataFrame, by: str = "doc_id", most: int = TARGETS) -> DataFrame:
    """(by, rank, seq) of units(by, seq, id, parent_id, kind, section, anchor_text, page_start, sent_start): ``most`` of each group, in the order they are chosen.

    By score, of equal ones the first, a unit is taken if its section (in any case) has less than PER_SECTION and its parent less than PER_PARENT so far; then
    those left are taken by score under the parent's quota alone. A unit without a parent is its own. Equal units are chosen in the order of their
    numbers; an empty table, or most of 0, gives no rows.

    Only the PER_PARENT best of a parent in a section can ever be taken, and of those the 2 x most best of the section, as of any better ones no more than
    most are taken and no more than most are of parents that are full; so what is brought together for a group is bounded by its sections.
    """
    if most <= 0:
        return units.select(by, F.lit(0).alias("rank"), "seq").limit(0)
    place = F.row_number().over(W.partitionBy(by).orderBy("seq")) - 1
    scored = units.withColumn("__place", place).select(by, "seq", F.lower(F.coalesce("section", F.lit(""))).alias("section"), F.coalesce("parent_id", "id").alias("parent"), (-F.round(target_score(F.col("__place")), 9)).alias("first"))
    near = scored.withColumn("__n", F.row_number().over(W.partitionBy(by, "section", "parent").orderBy("first", "seq"))).filter(F.col("__n") <= PER_PARENT)
    near = near.withColumn("__n", F.row_number().over(W.partitionBy(by, "section").orderBy("first", "seq"))).filter(F.col("__n") <= 2 * most)
    gathered = near.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("first", "seq", "section", "parent"))).alias("us"))
    none, counts = F.expr("cast(array() as array<bigint>)"), F.expr("cast(map() as map<string,int>)")
    of = lambda m, key: F.coalesce(F.element_at(m, key), F.lit(0))
    more = lambda m, key: F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, of(m, key) + 1))

    def take(s, u, free):
        fits = free & (F.size(s["taken"]) < most) & (of(s["parents"], u["parent"]) < PER_PARENT)
        return F.struct(
            F.when(fits, F.concat(s["taken"], F.array(u["seq"].cast("long")))).otherwise(s["taken"]).alias("taken"),
            F.when(fits, more(s["sections"], u["section"])).otherwise(s["sections"]).alias("sections"), F.when(fits, more(s["parents"], u["parent"])).otherwise(s["parents"]).alias("parents"),
        )

    start = F.struct(none.alias("taken"), counts.alias("sections"), counts.alias("parents"))
    diverse = F.aggregate("us", start, lambda s, u: take(s, u, of(s["sections"], u["section"]) < PER_SECTION))
    full = gathered.withColumn("s", diverse).withColumn("taken", F.aggregate("us", F.col("s"), lambda s, u: take(s, u, ~F.array_contains(s["taken"], u["seq"].cast("long"))), lambda s: s["taken"]))
    return full.select(by, F.posexplode("taken").alias("n", "seq")).select(by, (F.col("n") + 1).alias("rank"), F.col("seq").cast(units.schema["seq"].dataType).alias("seq"))
