"""Personal data by weak supervision (operator 4).

Patterns give base spans, which always stay, and looser candidates. Six labelers vote for, against or
not at all on every candidate: pattern, check, gazetteer, context, format and boundary. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely
each candidate is personal data; with these likelihoods as labels a naive Bayes classifier over
votes and shapes of spans is trained, and the candidates it accepts are added.

Everything is DataFrame functions. Texts are read once and are not shuffled. What the labelers and
the classifier learn from is counts over all documents: at most 3^6 vote patterns a kind, and a
fixed alphabet of features, both small at any input size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "format", "boundary")
ROUNDS = 20
ACCEPT_FROM = 0.8
CONTEXT_CHARS = 40

# Patterns of the base spans. Possessive where nothing can follow, and only from the start of a run of
# characters or the end of the match before, so that long runs take linear time.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of the looser candidates. Repeated groups are possessive: others are matched by recursion, once for each
#: repeat, and a long text would overflow the stack.
LOOSE = {
    "email": rf"(?i)(?<![{LOCAL}])[{LOCAL}]++(?:\x20?[(\[{{]at[)\]}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{{]dot[)\]}}]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": BASE["card"],
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+(.-])00[1-9][0-9]*+(?:[\x20().-]++[0-9]++)++",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Words that speak for a kind, or against any, in the characters before a span.
CUES = {
    "email": "contact|e-?mail|mail|mailto|write|reach|address|adresse|correo|courriel",
    "ip": "ip|ipv4|ipv6|host|server|address|addr|login|client|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|cc|karte|carte|tarjeta",
    "phone": "tel|telephone|phone|call|fax|mobile|cell|contact|sms|whatsapp|telefon|telefono|appelez",
}
AGAINST = "version|release|isbn|issn|doi|order|invoice|serial|sku|page|section|figure|password|secret|token|key|hash|commit|id"
#: Top-level domains, and first digits of payment cards.
DOMAINS = "com|org|net|edu|gov|info|io|biz|eu|de|fr|es|uk|it|nl|ch|at|be|pl|ru|jp|cn|in|br|us|ca|au|se|no|dk|fi|pt|ie|mx|ar"
CARD_PREFIX = "3[0-9]|4|5[1-5]|2[2-7]|6"

SPAN = "struct<kind:string,start:long,end:long,value:string,before:string,after:string>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), f)[0]


def find(text: Column, regex: str, kind: str) -> Column:
    """All matches as array<SPAN>, leftmost and non-overlapping, in code points with the end exclusive.

    The texts between the matches and the matches themselves give the places by their lengths, and what stands before and
    after each; the text isn't read again for a match. The running sum of n lengths is taken in about sqrt(n) groups, as an
    array that grows by one is copied at each step.
    """
    empty = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(state, pair):
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["hit"].alias("value"), pair["before"].alias("before"), pair["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def grouped(pairs):
        size = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / size).cast("int") - 1), lambda g: F.slice(pairs, g * size + 1, size))

    def spans(groups):
        zero = F.lit(0).cast("long")
        length = lambda group: F.aggregate(group, zero, lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"]))
        offset = lambda lengths, g: F.aggregate(F.slice(lengths, 1, g), zero, lambda n, x: n + x)
        inside = lambda group, at: F.aggregate(group, F.struct(at.alias("at"), empty.alias("found")), step, lambda s: s["found"])
        return _let(F.transform(groups, length), lambda lengths: F.flatten(F.transform(groups, lambda group, g: inside(group, offset(lengths, g)))))

    def paired(hits, gaps):
        tail = lambda c: F.right(c, F.lit(CONTEXT_CHARS))
        tails = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(tail(g).alias("gap"), F.concat(tail(g), tail(h)).alias("both")))
        # no match is shorter than five characters
        most = CONTEXT_CHARS // 5
        near = lambda t, i: F.array_join(F.transform(F.slice(t, F.greatest(i - most, F.lit(0)) + 1, F.least(i, F.lit(most))), lambda x: x["both"]), "")
        after = lambda i: F.left(F.concat(gaps[i + 1], F.coalesce(F.get(hits, i + 1), F.lit(""))), F.lit(1))
        return _let(tails, lambda t: F.transform(hits, lambda h, i: F.struct(
            gaps[i].alias("gap"), h.alias("hit"), tail(F.concat(near(t, i), t[i]["gap"])).alias("before"), after(i).alias("after")
        )))

    def placed(hits):
        return F.when(F.size(hits) == 0, empty).otherwise(_let(F.split(text, regex, -1), lambda gaps: _let(paired(hits, gaps), lambda p: _let(grouped(p), spans))))

    return _let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).try_cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans as array<SPAN>, by kind as in KINDS, then start; null texts have none."""
    whole = F.coalesce(text, F.lit(""))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = [F.when(F.contains(whole, F.lit(NEEDS[k])), _only_valid(find(whole, BASE[k], k), k)).otherwise(none) for k in KINDS]
    return F.concat(*found)


def _only_valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def loose_spans(text: Column, base: Column) -> Column:
    """Candidates beside the base spans, none of which they touch; of a kind's, cards of 13 to 19 digits only."""
    whole = F.coalesce(text, F.lit(""))
    guard = {"email": r"(?i)[(\[{\x20]at[)\]}\x20]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{4}[\\x20-]?[0-9]{4}", "phone": "[0-9]{3}[)\\x20.-]|00[1-9]"}
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = F.concat(*[F.when(whole.rlike(guard[k]), find(whole, LOOSE[k], k)).otherwise(none) for k in KINDS])
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    # a valid card is a base span, and shorter or longer numbers are none
    card = lambda s: (s["kind"] != "card") | F.length(_digits(s["value"])).between(13, 19) & ~_valid("card", s["value"])
    return F.filter(F.filter(found, card), apart)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def votes(span: Column, base: Column) -> Column:
    """The labelers' votes on a span, array<int> in the order of LABELERS: 1 for, -1 against, 0 none."""
    kind, value = span["kind"], span["value"]
    n = F.length(_digits(value))
    before, previous, following = F.lower(span["before"]), F.right(span["before"], F.lit(1)), span["after"]
    word = lambda words: before.rlike(rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])")
    check = _by_kind(kind, {
        "email": _vote(F.lower(value).rlike(rf"(?:\.|dot[)\]}}]?)\x20?(?:{DOMAINS})$"), F.lit(False)),
        "ip": _vote(base | value.contains(":"), F.lit(True)),
        "card": _vote(F.call_function("luhn_check", _digits(value)), F.lit(True)),
        "phone": _vote(n.between(9, 15), F.lit(True)),
    })
    gazetteer = _by_kind(kind, {
        "email": _vote(F.lower(value).rlike(rf"(?:{DOMAINS})$"), F.lit(True)),
        "ip": _vote(value.rlike("^(?:[1-9]|1?[0-9]{2}|2[0-4][0-9]|25[0-5])[.]") | value.contains(":"), value.rlike("^0")),
        "card": _vote(_digits(value).rlike(f"^(?:{CARD_PREFIX})"), F.lit(True)),
        "phone": _vote(value.rlike(r"^(?:\+|00)[1-9]") | value.rlike(r"^\(?[2-9][0-9]{2}"), F.lit(True)),
    })
    shape = _by_kind(kind, {
        "email": _vote(F.length(value) <= 64, F.lit(True)),
        "ip": _vote(F.length(value).between(7, 39), F.lit(True)),
        "card": _vote(n.isin(15, 16) & value.rlike("^(?:[0-9]+|[0-9]{4}(?:[\\x20-][0-9]{4}){3}|[0-9]{4}[\\x20-][0-9]{6}[\\x20-][0-9]{5})$"), F.lit(False)),
        "phone": _vote(value.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}$"), F.lit(False)),
    })
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & word(words))
    glued = previous.rlike(r"[\p{L}0-9_=]") | following.rlike(r"[\p{L}0-9_]")
    return F.array(base.cast("int"), check, gazetteer, _vote(cue, word(AGAINST)), shape, _vote(~glued, glued))


def shapes(span: Column) -> Column:
    """Features of a span from a fixed alphabet: its length, digits, separators and first character in classes."""
    value = span["value"]
    size = lambda name, c, edges: F.concat(F.lit(name), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= c)).cast("string"))
    first = F.when(value.rlike("^[0-9]"), "first:digit").when(value.rlike("^[A-Za-z]"), "first:letter").otherwise("first:other")
    return F.array(size("length:", F.length(value), [8, 12, 16, 20, 30]), size("digits:", F.length(_digits(value)), [1, 7, 9, 12, 15, 17]), size("parts:", F.regexp_count(value, F.lit("[^A-Za-z0-9]+")), [1, 2, 3, 4, 6]), first)


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``spans``: base spans and candidates with flag base, votes and features."""
    marked = lambda spans, base: F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), votes(s, F.lit(base)).alias("votes"), shapes(s).alias("shapes")
    ))
    found = docs.withColumn("__base", base_spans(F.col(text)))
    found = found.withColumn("__loose", loose_spans(F.col(text), F.col("__base")))
    return found.withColumn("spans", F.concat(marked(F.col("__base"), True), marked(F.col("__loose"), False))).drop("__base", "__loose")


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


#: What each class' votes count before any is seen, for -1, 0, 1: labelers are taken to be right more often than not.
ANCHOR_YES, ANCHOR_NO = (1.0, 2.0, 4.0), (4.0, 2.0, 1.0)


def reliabilities(spans: DataFrame) -> DataFrame:
    """(kind, votes, likelihood): for each vote pattern of spans(kind, votes) the likelihood that it is personal data, by ROUNDS of expectation maximisation."""
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n")).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    at = F.col("patterns")
    start = F.transform(at, lambda p: _logistic(F.aggregate(p["votes"], F.lit(0.0), lambda s, v: s + v)))
    yes_first, no_first = F.array(*map(F.lit, ANCHOR_YES)), F.array(*map(F.lit, ANCHOR_NO))

    def weights(rows, yes, no):
        """For each labeler and vote the log of how much likelier the vote is on personal data."""
        def weight(labeler, vote):
            seen = F.filter(rows, lambda r: r["votes"][labeler] == vote - 1)
            share = lambda name, first, total: (_total(F.transform(seen, lambda r: r[name])) + first[vote]) / (total + float(sum(ANCHOR_YES)))
            return F.log(share("yes", yes_first, yes)) - F.log(share("no", no_first, no))

        return F.transform(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), lambda l: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda v: weight(l, v)))

    def step(likelihoods, _):
        rows = F.zip_with(at, likelihoods, lambda p, q: F.struct(p["votes"].alias("votes"), (p["n"] * q).alias("yes"), (p["n"] * (1 - q)).alias("no")))

        def update(r):
            yes, no = _total(F.transform(r, lambda x: x["yes"])), _total(F.transform(r, lambda x: x["no"]))
            prior = F.log((yes + 1) / (no + 1))
            return _let(F.struct(weights(r, yes, no).alias("w"), prior.alias("prior")), lambda m: F.transform(at, lambda p: _logistic(
                m["prior"] + _total(F.transform(p["votes"], lambda v, l: m["w"][l][v + 1]))
            )))

        return _let(rows, update)

    fitted = patterns.withColumn("likelihoods", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    both = F.arrays_zip(F.col("patterns.votes").alias("votes"), F.col("likelihoods").alias("likelihood"))
    return fitted.select("kind", F.explode(both).alias("p")).select("kind", "p.votes", "p.likelihood")


def _features(span: Column) -> Column:
    return F.concat(F.transform(span["votes"], lambda v, l: F.concat_ws(":", F.lit("vote"), l, v)), span["shapes"])


def train(spans: DataFrame) -> DataFrame:
    """(feature, weight): naive Bayes log odds by kind and feature, with the likelihoods of expectation maximisation as labels."""
    labelled = spans.join(F.broadcast(reliabilities(spans)), ["kind", "votes"])  # at most 3^6 rows a kind
    said = F.concat(F.array(F.lit("any")), _features(F.struct("votes", "shapes")))
    counts = labelled.select(F.col("kind"), F.explode(said).alias("f"), "likelihood").groupBy("kind", "f").agg(F.sum("likelihood").alias("yes"), F.sum(1 - F.col("likelihood")).alias("no"))
    totals = counts.filter("f = 'any'").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    odds = F.log((F.col("yes") + 1) / (F.col("all_yes") + 4)) - F.log((F.col("no") + 1) / (F.col("all_no") + 4))
    prior = F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))
    return counts.join(F.broadcast(totals), "kind").select(F.concat_ws("|", "kind", "f").alias("feature"), F.when(F.col("f") == "any", prior).otherwise(odds).alias("weight"))


def detect(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns keep of docs and ``spans``: array of (kind, start, end, base, score), by kind as in KINDS, then start.

    A row for each row of docs. Base spans are all there, with their score; other candidates from ACCEPT_FROM on.
    Null and empty texts have no spans; if there are no spans at all nothing is learned. Repeated rows have equal spans.
    """
    found = cut(candidates(docs, text).select(*keep, "spans"))
    model = train(found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.shapes"))
    table_ = model.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight")))).scalar()
    weight = lambda m, kind, f: F.coalesce(F.element_at(m, F.concat_ws("|", kind, f)), F.lit(0.0))
    score = lambda s: _logistic(weight(F.col("__model"), s["kind"], F.lit("any")) + _total(F.transform(_features(s), lambda f: weight(F.col("__model"), s["kind"], f))))
    order = F.array(*map(F.lit, KINDS))
    judged = F.transform("spans", lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), score(s).alias("score")))
    kept = F.sort_array(F.filter(judged, lambda s: s["base"] | (s["score"] >= ACCEPT_FROM)))
    return found.withColumn("__model", table_).withColumn("spans", F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base", "score")]))).drop("__model")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
