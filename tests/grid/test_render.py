"""Render models by type, references in order, defaults."""

from pyspark.sql import functions as F

from cellward.operators import render

KIND = "id int, block_type string, title string, content string, data map<string,string>, ids array<string>"


def test_types_and_their_defaults(spark):
    rows = [(1, "callout", "", None, {}, ["b", "x", "a", "b"]), (2, "animated-quote", None, None, {"text": "hi"}, None), (3, "markdown", "gone", "", {"content": "c"}, []), (4, "map", None, "own", {"title": "t", "z": "1"}, ["a"]), (5, "timeline", "gone", "gone", {"title": "t"}, None), (6, None, "n", None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    got = {r.id: r for r in render.model(df, ["id"]).collect()}
    assert (got[1].title, got[1].content, got[1].variant, got[1].rest) == ("", "", "default", None)
    assert (got[2].text, got[2].author, got[2].title) == ("hi", "", "")
    assert (got[3].title, got[3].content) == (None, "c") and (got[5].title, got[5].content, got[5].rest) == (None, None, None)
    assert (got[4].title, got[4].content, got[4].rest) == ("t", "own", {"title": "t", "z": "1"}) and got[6].type is None
    refs = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    own = df.withColumnRenamed("id", "block")
    found = {r.block: [x.name for x in r.references] for r in render.resolved(own, ["block"], "ids", refs).collect()}
    assert found == {1: ["B", "A", "B"], 2: [], 3: [], 4: ["A"], 5: [], 6: []}
    assert render.visualisations(df.withColumn("block_type", F.lit("visualization")).limit(1), ["id"]).first().type == "map"


def test_texts_and_files(spark):
    df = spark.createDataFrame([("abc", 1), ("abc", 9), ("", 0)], "t string, k int")
    assert [r[0] for r in df.select(render.cited_at(F.col("t"), F.col("k"), F.lit("x"))).collect()] == ["a\\cite{x}bc", "abc\\cite{x}", "\\cite{x}"]
    files = spark.createDataFrame([("a.TIFF",), ("b.gpkg",), ("c.d/e",), ("",)], "f string")
    assert [r[0] for r in files.select(render.file_content_type(F.col("f"))).collect()] == ["image/tiff", "application/geopackage+sqlite3", render.ANY_CONTENT, render.ANY_CONTENT]
