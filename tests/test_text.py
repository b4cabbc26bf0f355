import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("line, expected", [
    ("2 Method", True), ("2. Method", True), ("IV. Experiments", True), ("RELATED WORK", True), ("Abstract", True), ("3.1 Residual Forces", True), ("Results are shown in Table 2", True),
    ("We find that the method is better than all of the others before.", False), ("", False), ("1 2 3", False), ("x" * 80, False), ("just some words", False),
])
def test_headings(spark, line, expected):
    assert value(spark, T.is_heading(F.lit(line))) is expected


def test_tokens(spark):
    found = value(spark, T.tokens(F.lit("MPC residual-force Go2 L1 état")))
    assert found == ["mpc", "residual", "force", "go", "2", "1", "tat"]
    assert value(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_sentences_keep_abbreviations(spark):
    text = "We use e.g. Fig. 2 and Eq. 3. Smith et al. Showed it. [1] says so! “Quoted.” lower stays. Next"
    assert value(spark, T.sentences(F.lit(text))) == ["We use e.g. Fig. 2 and Eq. 3.", "Smith et al. Showed it.", "[1] says so!", "“Quoted.” lower stays.", "Next"]


def test_ground_sentences_drop_short_ones(spark):
    assert value(spark, T.ground_sentences(F.lit("Short one.\nThis one is long enough. And this one as well!"))) == ["This one is long enough.", "And this one as well!"]


def test_sizes_and_hash(spark):
    assert value(spark, T.estimate_tokens(F.lit(""))) == 1
    assert value(spark, T.utf16_length(F.lit("a😀b"))) == 4
    assert value(spark, T.content_hash(F.lit("a"))) == "e40c292c1"


def test_locator_and_cite(spark):
    n = lambda x: F.lit(x).cast("int")
    assert value(spark, T.locator(F.lit("Method (2)"), (n(2), n(2)), (n(1), n(3)), (n(4), n(4)))) == "Method · ¶2 · s1–3 · p.4"
    assert value(spark, T.cite(F.lit("Introduction"), n(2), n(3), n(2))) == "[§Introduction ¶2 s3 p.2]"


def test_markup(spark):
    assert value(spark, T.unescape_html(T.escape_html(F.lit("a < b & \"c\" 가"), quote=False))) == "a < b & \"c\" 가"
    assert value(spark, T.merge_repeated_cites(F.lit("so [1][1] it is"))) == "so [1] it is"
    assert value(spark, T.normalize_color(F.lit("#AbC"))) == "#aabbcc"
    assert value(spark, T.anchor(F.lit("First. Second one here. Third."))) == "First. Second one here."
