"""Leading-call throttle: the first call opens a span, calls inside it are painted with it at its end, the next call after it opens another.

Which calls open a span depends on all before them, but little has to be looked at. Time is cut into cells as long as the gap, so spans open in a cell once at
most. The call that would open the next span after a call is its successor: the first one at its offset or later in the next cell, else the
first one of the cell after that. The first call of a cell after an empty cell opens in any case. From these starts the openers are found by doubling:
pointers to the successor, the second, the fourth, and so on, while any are left. Calls of a key are joined by key and cell, so a key that
has most of all calls is no single task; equal times are one call before anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import dropped, stored


def _cells(calls: DataFrame, gap: int) -> DataFrame:
    """(key, cell, offs): the distinct offsets of each cell, in order; at most ``gap`` of them."""
    return calls.groupBy("key", "cell").agg(F.sort_array(F.collect_set("off")).alias("offs"))


def _next(cells: DataFrame, by: int, *columns) -> DataFrame:
    """What a cell sees of the one ``by`` cells on."""
    return cells.select("key", (F.col("cell") - by).alias("cell"), *columns)


def openers(calls: DataFrame, gap: int) -> DataFrame:
    """(key, at): the calls(key, at) that open a span of ``gap``; keys and times are not null, times whole numbers."""
    points = calls.select("key", F.floor(F.col("at") / gap).cast("long").alias("cell"), F.pmod("at", F.lit(gap)).cast("long").alias("off"))
    cells = stored(_cells(points, gap))
    time = lambda cell, off: cell * gap + off
    c = F.col
    starts = cells.join(_next(cells, -1), ["key", "cell"], "left_anti").select("key", time(c("cell"), c("offs")[0]).alias("at"))
    two = cells.join(_next(cells, 1, c("offs").alias("following")), ["key", "cell"]).join(_next(cells, 2, c("offs")[0].alias("first_after")), ["key", "cell"], "left")

    def successor(off):
        later = F.get(F.filter(c("following"), lambda x: x >= off), F.lit(0))
        return F.coalesce(time(c("cell") + 1, later), time(c("cell") + 2, c("first_after")))

    jumps = two.select("key", F.explode(F.transform("offs", lambda off: F.struct(time(c("cell"), off).alias("at"), successor(off).alias("to")))).alias("j")).select("key", "j.at", "j.to")
    jumps, reached = stored(jumps.filter("to is not null")), stored(starts)
    while not jumps.isEmpty():
        # the openers so far and those that the pointers lead to from them
        more = reached.join(jumps, ["key", "at"]).select("key", c("to").alias("at"))
        after = stored(reached.union(more).distinct())
        ahead = stored(jumps.join(jumps.select("key", c("at").alias("to"), c("to").alias("then")), ["key", "to"]).select("key", "at", c("then").alias("to")))
        dropped(reached, jumps)
        reached, jumps = after, ahead
    dropped(jumps, cells)
    return reached


def throttle(calls: DataFrame, key: str, at: str, value: str, gap_ms: int = 80) -> DataFrame:
    """(key, opened, painted, n, value) of calls: one row a span, with the number of its calls and the value of its last one (of equal times the greatest).

    Calls without a time are left out; those without a key are of one key. Repeated calls count. An empty table gives no rows.
    """
    if gap_ms < 1:
        raise ValueError("gap_ms: 1 or more")
    gap, c = gap_ms * 1000, F.col
    named = calls.filter(c(at).isNotNull()).select(F.struct(c(key).alias("k")).alias("key"), F.unix_micros(c(at).cast("timestamp")).alias("at"), c(value).alias("value"))
    once = stored(named.groupBy("key", "at").agg(F.count("*").alias("n"), F.max("value").alias("value")))
    opened = openers(once.select("key", "at"), gap).select("key", F.floor(c("at") / gap).cast("long").alias("cell"), c("at").alias("opened"))
    placed = once.withColumn("cell", F.floor(c("at") / gap).cast("long"))
    # a cell has one opener at most; a call is of its own cell's unless that comes later, else of the one before
    both = placed.join(opened, ["key", "cell"], "left").join(_next(opened, -1, c("opened").alias("before")), ["key", "cell"], "left")
    spans = both.withColumn("opened", F.when(c("opened") <= c("at"), c("opened")).otherwise(c("before")))
    out = spans.groupBy("key", "opened").agg(F.sum("n").alias("n"), F.max_by("value", "at").alias("value"))
    return out.select(c("key.k").alias("key"), F.timestamp_micros("opened").alias("opened"), F.timestamp_micros(c("opened") + gap).alias("painted"), "n", "value")
