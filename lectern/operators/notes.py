"""Notes, chats and stickies as tables: encoding, decoding, clean-up and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

ROLES = ("user", "assistant", "system")
CHAT_IMAGE, CHAT_TURNS, STICKY_IMAGE = 80_000, 60, 200_000
STICKY_WIDTH, STICKY_HEIGHT, STICKY_LEFT, STICKY_TOP, STICKY_STEP = 320, 280, 24, 80, 28


def encode_note(kind: Column, payload: Column) -> Column:
    """A note's body: the payload's JSON, escaped, in a preformatted block that names its kind."""
    return F.concat(F.lit('<div data-kind="'), kind, F.lit('"><pre>'), T.escape_html(payload, quote=False), F.lit("</pre></div>"))


def decode_note(html: Column) -> Column:
    """struct(kind, payload) of a note's body; null where it is none."""
    kind = F.regexp_extract(html, r'data-kind="([^"]*)"', 1)
    body = T.unescape_html(F.regexp_extract(html, r"(?s)<pre[^>]*>(.*?)</pre>", 1))
    return F.when((kind != "") & (body != ""), F.struct(kind.alias("kind"), body.alias("payload")))


def clean_chat(turns: DataFrame, by: str, order: str, role: str = "role", keep: int = CHAT_TURNS) -> DataFrame:
    """The last turns of each chat, unknown roles read as user, images that are too long dropped."""
    out = turns.withColumn(role, F.when(F.col(role).isin(*ROLES), F.col(role)).otherwise("user"))
    if "image" in turns.columns:
        out = out.withColumn("image", F.when(F.length("image") <= CHAT_IMAGE, F.col("image")))
    return out.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("__n") <= keep).drop("__n")


def last_answer(turns: DataFrame, by: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(by, answer): the last turn of the assistant that says anything."""
    said = turns.filter((F.col(role) == "assistant") & (T.trim(T.whole(F.col(text))) != ""))
    return said.groupBy(by).agg(F.max_by(text, order).alias("answer"))


def latest(rows: DataFrame, key: list[str], at: str, position: str) -> DataFrame:
    """The row of each key with the latest time, of equal ones the last by position; at the place of its first."""
    window = W.partitionBy(*key)
    marked = rows.withColumn("first_position", F.min(position).over(window)).withColumn("__n", F.row_number().over(window.orderBy(F.desc(at), F.desc(position))))
    return marked.filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, new values that aren't null win."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [o[k].eqNullSafe(n[k]) for k in key], "full_outer")
    columns = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in old.columns]
    return joined.select(*columns)


def upsert_stickies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stickies(id, item_key, x, y, w, h, collapsed, pinned, created_at, ...) of both by id, with old's columns.

    Where old has one, new values that aren't null win, but for created_at and pinned. Others get default places and sizes, each below the ones of
    its item before it, by time and id. new has one row an id (see latest()) and old's columns.
    """
    known = old.select("id").distinct()
    changed = upsert(old, new.join(known, "id", "left_semi").drop("created_at", "pinned"), ["id"])
    before = old.groupBy("item_key").agg(F.count("*").alias("__n"))
    fresh = new.join(known, "id", "left_anti").join(before, "item_key", "left")
    place = F.coalesce("__n", F.lit(0)) + F.row_number().over(W.partitionBy("item_key").orderBy("created_at", "id")) - 1
    defaults = {"x": F.lit(STICKY_LEFT), "y": F.lit(STICKY_TOP) + STICKY_STEP * place, "w": F.lit(STICKY_WIDTH), "h": F.lit(STICKY_HEIGHT), "collapsed": F.lit(False), "pinned": F.lit(True)}
    return changed.unionByName(fresh.withColumns({c: F.coalesce(c, v).cast(old.schema[c].dataType) for c, v in defaults.items()}).select(*old.columns))


def clean_stickies(rows: DataFrame) -> DataFrame:
    """Stickies with an id, pinned unless told otherwise, without images that are too long."""
    return rows.filter(F.coalesce("id", F.lit("")) != "").filter(F.coalesce("pinned", F.lit(True))).withColumn("image", F.when(F.length("image") <= STICKY_IMAGE, F.col("image")))


def page_index(position_page: Column, page: Column, label: Column) -> Column:
    """Where a sticky is: its position's page, its page, its label less one, or the end."""
    return F.coalesce(position_page, page, label.try_cast("int") - 1, F.lit(9999))


def reading_order(rows: DataFrame, by: str, page: Column, top: Column, created: str) -> DataFrame:
    """rows with ``place``: by page, from the top of the page (PDF rectangles count from below), then by time."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(page, top.desc_nulls_last(), created)))
