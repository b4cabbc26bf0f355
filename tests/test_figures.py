from pyspark.sql import functions as F

from lectern.operators import figures

TEXT = """Figure 1. Training curves of the model.
Some prose.

As shown in Figure 1, the training curves fall with the number of steps that are taken.

Table 2: Results of all runs

The results in Table 2 compare the runs over all of the data that was used here."""
SCHEMA = "text string, question string, page string, prefer array<string>"


def test_bundle(spark):
    rows = [(TEXT, "what falls", "4", None), (TEXT, None, None, ["Table 2", ""]), (None, None, None, None), ("no such thing", "q", "", [])]
    got = [r[0] for r in spark.createDataFrame(rows, SCHEMA).select(figures.bundle(F.col("text"), F.col("question"), F.col("page"), F.col("prefer"))).collect()]
    assert got[0].labels == ["Figure 1.", "Table 2"] or got[0].labels == ["Figure 1", "Table 2"]
    lines = got[0].block.split("\n")
    assert lines[0] == figures.HEAD and lines[1] == "Page focus: p.4" and lines[2] == figures.CAPTIONS and lines[3].startswith("Figure 1") and figures.DISCUSSION in lines
    assert got[0].query.startswith("what falls\n" + figures.BOOST) and got[0].query.endswith("page 4") and len(got[0].paragraphs) >= 2
    assert got[1].labels[0] == "Table 2" and "Table 2" in got[1].paragraphs[0] and "Page focus" not in got[1].block
    for r, query in ((got[2], figures.BOOST), (got[3], "q\n" + figures.BOOST)):
        assert r.block == f"{figures.HEAD}\n{figures.NOTHING}" and r.query == query and r.mentions == [] and r.labels == []
