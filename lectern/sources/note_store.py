"""Notes that keep chats, stickies and summaries of an item as JSON in their bodies: found, read, saved, with older files behind them.

Notes are rows (parent, note_id, position, tags, body); payloads are rows (parent, kind, payload). Rows without a parent belong to nothing and are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import notes as N

KINDS = ("chat", "sticky", "summary")
#: Tags are this, a hyphen and the kind.
ROOT = "lectern"
#: Parents that stand for no item.
NOBODY = ("", "unknown")
STICKY = (
    "id string, kind string, quote string, answer string, pageLabel string, x double, y double, w double, h double, collapsed boolean, createdAt string, pinned boolean, "
    "position struct<pageIndex:int,pageLabel:string,rects:array<array<double>>>, imageDataUrl string, annotationKey string"
)


def read_body(body: Column) -> Column:
    """struct(kind, payload) of a note's body; null if it names no kind or holds no JSON. Entities are read as characters if that gives JSON, else as they are."""
    kind = F.lower(F.regexp_extract(body, rf"""(?i)data-kind=["']({"|".join(KINDS)})["']""", 1))
    raw = T.trim(F.regexp_extract(body, r"(?is)<pre[^>]*>(.*?)</pre>", 1))
    plain = T.unescape_html(raw)
    is_json = lambda c: F.try_parse_json(c).isNotNull()
    payload = F.when(is_json(plain), plain).when(is_json(raw), raw)
    return F.when((kind != "") & payload.isNotNull(), F.struct(kind.alias("kind"), payload.alias("payload")))


def find_notes(notes: DataFrame, root: str = ROOT) -> DataFrame:
    """(parent, kind, note_id, payload): for each parent and kind the first note, by position and then id, that has the kind's tag or a body of that kind.

    payload is null where the note that is found has a body of another kind, or none. Empty tables give no rows.
    """
    tagged = lambda k: F.coalesce(F.array_contains("tags", F.concat(F.lit(f"{root}-"), k)), F.lit(False))
    read = notes.filter("parent is not null").select("parent", "note_id", "position", "tags", read_body(F.col("body")).alias("b"))
    fits = F.filter(F.array(*map(F.lit, KINDS)), lambda k: tagged(k) | F.coalesce(k == F.col("b.kind"), F.lit(False)))
    each = read.select("parent", "note_id", "position", "b", F.explode(fits).alias("kind"))
    payload = F.when(F.col("b.kind") == F.col("kind"), F.col("b.payload"))
    first = each.groupBy("parent", "kind").agg(F.min_by(F.struct("note_id", payload.alias("payload")), F.struct("position", "note_id")).alias("found"))
    return first.select("parent", "kind", "found.note_id", "found.payload")


def payloads_of(notes: DataFrame, root: str = ROOT) -> DataFrame:
    """(parent, kind, payload) of the notes that find_notes() finds, but for those without a payload and parents that stand for no item."""
    return find_notes(notes, root).filter(F.col("payload").isNotNull() & ~F.col("parent").cast("string").isin(*NOBODY)).drop("note_id")


def save_payloads(notes: DataFrame, payloads: DataFrame, root: str = ROOT) -> DataFrame:
    """notes after payloads(parent, kind, payload, at) are saved: in the note that find_notes() finds, which gets the kind's tag, else in a new one behind the parent's others.

    Of several payloads for a parent and kind, or for a note that is found for two kinds, that with the latest ``at`` stays, of equal ones the greatest.
    Payloads that are null, of unknown kinds or of no item are left out. A new note's id is made from parent and kind, so a repeated run makes the same; columns of notes
    that payloads lack are null in new ones.
    """
    c = F.col
    asked = payloads.filter(c("kind").isin(*KINDS) & c("payload").isNotNull() & ~c("parent").cast("string").isin(*NOBODY))
    latest = asked.groupBy("parent", "kind").agg(F.max(F.struct("at", "payload")).alias("new"))
    placed = latest.join(find_notes(notes, root).drop("payload"), ["parent", "kind"], "left")
    changed = placed.filter("note_id is not null").groupBy("parent", "note_id").agg(F.max(F.struct("new.at", "new.payload", "kind")).alias("__new"), F.array_sort(F.collect_set("kind")).alias("__kinds"))
    tags = F.array_union(F.coalesce("tags", F.expr("cast(array() as array<string>)")), F.transform("__kinds", lambda k: F.concat(F.lit(f"{root}-"), k)))
    kept = notes.join(changed, ["parent", "note_id"], "left")
    body = F.when(c("__new").isNotNull(), N.encode_note(c("__new.kind"), c("__new.payload"))).otherwise(c("body"))
    kept = kept.withColumns({"body": body, "tags": F.when(c("__kinds").isNotNull(), tags).otherwise(c("tags"))}).select(*notes.columns)
    behind = notes.groupBy("parent").agg(F.max("position").alias("__last"))
    place = F.coalesce(c("__last"), F.lit(0)) + F.array_position(F.array(*map(F.lit, KINDS)), c("kind"))
    made = placed.filter("note_id is null").join(behind, "parent", "left").select(
        "parent", F.left(F.sha2(F.concat_ws("\n", c("parent").cast("string"), "kind"), 256), F.lit(16)).cast(notes.schema["note_id"].dataType).alias("note_id"),
        place.cast(notes.schema["position"].dataType).alias("position"), F.array(F.concat(F.lit(f"{root}-"), c("kind"))).alias("tags"), N.encode_note(c("kind"), c("new.payload")).alias("body"),
    )
    return kept.unionByName(made, allowMissingColumns=True)


def _elements(payload: Column, field: str) -> Column:
    """The elements of a JSON array, or of the one in an object's field, each as JSON; null without one."""
    p = T.trim(T.whole(payload))
    inner = F.when(p.startswith("["), p).otherwise(F.get_json_object(p, f"$.{field}"))
    return F.from_json(F.when(inner.startswith("["), inner), "array<string>")


def _first_source(payloads: DataFrame, files: DataFrame | None, kind: str, rows: Column) -> DataFrame:
    """(parent, source, rows): a parent's rows in its note, else those in its file(parent, payload); parents without any have no row."""
    both = payloads.filter(F.col("kind") == kind).select("parent", "payload", F.lit("note").alias("source"))
    if files is not None:
        both = both.unionByName(files.select("parent", "payload", F.lit("file").alias("source")))
    read = both.filter(F.col("parent").isNotNull() & ~F.col("parent").cast("string").isin(*NOBODY)).withColumn("rows", rows).filter(F.size("rows") > 0)
    # note before file; of several files of a parent that with the least digest
    order = F.struct((F.col("source") == "file").alias("file"), F.sha2("payload", 256).alias("digest"))
    return read.groupBy("parent").agg(F.min_by(F.struct("source", "rows"), order).alias("r")).select("parent", "r.source", "r.rows")


def chat_turns(payloads: DataFrame, files: DataFrame | None = None, keep: int = N.CHAT_TURNS) -> DataFrame:
    """(parent, turn, role, content, image, caption, source): the last turns of each chat, from its note, or from its older file where that has none.

    A payload is an array of turns or an object with one as ``history``; anything else has no turns. Turns without a role or content go; roles but assistant are user;
    images that are too long go with their captions. turn counts from 0 among those kept.
    """
    turn = lambda e: F.from_json(e, "role string, content string, imageDataUrl string, imageCaption string")
    said = F.filter(F.transform(_elements(F.col("payload"), "history"), turn), lambda t: (F.coalesce(t["role"], F.lit("")) != "") & t["content"].isNotNull())

    def slim(t):
        fits = F.length(t["imageDataUrl"]).between(1, N.CHAT_IMAGE)
        role = F.when(t["role"] == "assistant", "assistant").otherwise("user")
        caption = F.when(fits, F.nullif(t["imageCaption"], F.lit("")))
        return F.struct(role.alias("role"), t["content"].alias("content"), F.when(fits, t["imageDataUrl"]).alias("image"), caption.alias("caption"))

    last = lambda a: F.slice(a, F.greatest(F.size(a) - keep, F.lit(0)) + 1, F.lit(keep))
    rows = F.transform(F.array(F.transform(said, slim)), last)[0]
    return _first_source(payloads, files, "chat", rows).select("parent", "source", F.posexplode("rows").alias("turn", "r")).select("parent", "turn", "r.*", "source")


def chat_payloads(turns: DataFrame, at: str, keep: int = N.CHAT_TURNS) -> DataFrame:
    """(parent, kind, payload, at): what save_payloads() takes for turns(parent, turn, role, content, image, caption): the last of each chat as JSON, stamped with the time.

    Turns without a role or content go before the last are counted, as in chat_turns(); image and caption may be missing.
    """
    said = turns.filter((F.coalesce("role", F.lit("")) != "") & F.col("content").isNotNull() & F.col("parent").isNotNull())
    slim = N.clean_chat(said.withColumn("role", F.when(F.col("role") == "assistant", "assistant").otherwise("user")), "parent", "turn", keep=keep)
    extra = [F.col(c).alias(name) for c, name in (("image", "imageDataUrl"), ("caption", "imageCaption")) if c in turns.columns]
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", "content", *extra).alias("t")))), lambda x: x["t"])
    return _stamped(slim.groupBy("parent").agg(history.alias("history")), "chat", at, "history")


def cleared_chats(parents: DataFrame, at: str) -> DataFrame:
    """(parent, kind, payload, at): empty chats for parents(parent), as clearing saves them."""
    return _stamped(parents.select("parent").distinct().withColumn("history", F.expr("cast(array() as array<struct<role:string,content:string>>)")), "chat", at, "history")


def _stamped(rows: DataFrame, kind: str, at: str, *fields: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("parent").cast("string").alias("itemKey"), F.lit(at).alias("updatedAt"), *fields))
    return rows.select("parent", F.lit(kind).alias("kind"), payload.alias("payload"), F.lit(at).alias("at"))


def stickies(payloads: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(parent, fields of STICKY, source, first_position): the stickies of each item's note, or of its older file where that has none; of equal ids the latest.

    A payload is an array of stickies or an object with one as ``stickies``. Those without an id, or no longer pinned, go; images that are too long are left out.
    """
    kept = F.filter(F.transform(_elements(F.col("payload"), "stickies"), lambda e: F.from_json(e, STICKY)), lambda s: (F.coalesce(s["id"], F.lit("")) != "") & F.coalesce(s["pinned"], F.lit(True)))
    each = _first_source(payloads, files, "sticky", kept).select("parent", "source", F.posexplode("rows").alias("place", "s")).select("parent", "s.*", "source", "place")
    slim = each.withColumn("imageDataUrl", F.when(F.length("imageDataUrl") <= N.STICKY_IMAGE, F.col("imageDataUrl")))
    return N.latest(slim, ["parent", "id"], "createdAt", "place").drop("place")


def dismiss(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Stickies(parent, id, ...) but for gone(parent, id)."""
    return rows.join(gone.select("parent", "id"), ["parent", "id"], "left_anti")


def collapse(rows: DataFrame, collapsed: bool, which: Column | None = None) -> DataFrame:
    """Stickies collapsed or opened: all, or those that a condition names."""
    return rows.withColumn("collapsed", F.lit(collapsed) if which is None else F.when(F.coalesce(which, F.lit(False)), F.lit(collapsed)).otherwise(F.col("collapsed")))


def summaries(payloads: DataFrame) -> DataFrame:
    """(parent, updated_at, markdown, provider, model) of the summaries that say anything; fields that are missing are null, a missing time is empty."""
    fields = F.from_json("payload", "updatedAt string, markdown string, provider string, model string")
    read = payloads.filter((F.col("kind") == "summary") & T.trim(F.col("payload")).startswith("{")).select("parent", fields.alias("f"))
    empty = lambda c: F.nullif(c, F.lit(""))
    return read.select("parent", F.coalesce("f.updatedAt", F.lit("")).alias("updated_at"), T.trim(F.col("f.markdown")).alias("markdown"), empty(F.col("f.provider")).alias("provider"), empty(F.col("f.model")).alias("model")).filter(
        "markdown <> ''"
    )


def summary_payloads(rows: DataFrame, at: str) -> DataFrame:
    """(parent, kind, payload, at): what save_payloads() takes for rows(parent, markdown, provider, model)."""
    return _stamped(rows.withColumn("markdown", T.trim(T.whole(F.col("markdown")))), "summary", at, "markdown", "provider", "model")
