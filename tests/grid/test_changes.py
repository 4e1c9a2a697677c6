"""Logs of changes, published versions, and the functions that no query reaches."""

import pytest

from cellward.operators import content, raster, spatial, tabular, web
from cellward.sources import storage
from pyspark.sql import functions as F

KIND = "id int, story int, place int, body string, version int, deleted boolean"


def test_a_log_applied_twice_changes_nothing(spark, tmp_path):
    base = spark.createDataFrame([(1, 1, 1, "a", 1, False), (2, 1, 2, "b", 1, False), (3, 1, 3, "c", 5, False), (9, 2, 4, "z", 0, False)], KIND)
    log = spark.createDataFrame([(2, 1, 2, "b", 2, True), (3, 1, 3, "old", 4, False), (4, 1, 2, "new", 1, False), (1, 1, 7, "A", 3, False), (2, 1, 2, "again", 1, False), (5, 2, 1, "x", 2, False), (5, 2, 1, "x", 2, True)], KIND)
    once = content.merged(base, log, ["id"])
    path = f"file://{tmp_path}/blocks"
    assert storage.publish(base, path) == 1 and storage.publish(once, path) == 2
    stored = storage.published(spark, path)
    again = content.merged(stored, log, ["id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    rows = {(r.story, r.place, r.body) for r in content.visible(again, "story", "place", ["id"]).collect()}
    assert rows == {(1, 1, "new"), (1, 2, "c"), (1, 3, "A"), (2, 1, "z")}
    assert content.visible(content.merged(base.limit(0), log.limit(0), ["id"]), "story", "place", ["id"]).count() == 0


def test_small_operators(spark):
    refs = spark.createDataFrame([(1, 2001), (2, None), (3, 2020), (4, 2001)], "id int, year int")
    assert {r.id: r.place for r in content.newest_first(refs, "year").collect()} == {3: 1, 1: 2, 4: 2, 2: 4}
    files = spark.createDataFrame([("a_GDP",), ("a_freight_loading",), ("a_hrst",), (None,)], "f string")
    assert [r.f for r in web.outputs_of(files, "f", ["gdp", "freight"], ["loading"]).collect()] == ["a_GDP"]
    names = spark.createDataFrame([("Port A", False), ("port total", True), ("x", None), (None, False), ("PORT B", None)], "n string, t boolean")
    assert {r.n for r in web.by_prefix(names, "n", "pOrt", F.col("t")).collect()} == {"Port A", "PORT B"}
    assert tabular.single(refs.where("id = 3")).year == 2020 and tabular.single(refs.where("id = 7")) is None
    with pytest.raises(ValueError, match="more than one"):
        tabular.single(refs)
    done = spark.createDataFrame([("a", 1), ("b", 5)], "path string, mtime int")
    found = spark.createDataFrame([("a", 2), ("b", 5), ("c", 0)], "path string, mtime int")
    assert {r.path for r in tabular.incremental(found, done).collect()} == {"a", "c"}
    assert raster.overview_levels(2100, 900) == [2, 4, 8] and raster.overview_levels(100, 100) == []
    cells = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0)], "row int, col int, v double")
    assert [r.v for r in raster.masked(cells, cells.limit(1), ["v"]).orderBy("col").collect()] == [2.0, 0.0]
    x, y = raster.centre(100.0, 50.0, 10.0)
    assert cells.select(x.alias("x"), y.alias("y")).orderBy("x").first() == (105.0, 45.0)
    boxes = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (2.0, 1.0, 3.0, 4.0)), ((0.0, 0.0, 2.0, 2.0), (2.1, 0.0, 3.0, 1.0))], "a struct<min_x: double, min_y: double, max_x: double, max_y: double>, b struct<min_x: double, min_y: double, max_x: double, max_y: double>")
    assert [r[0] for r in boxes.select(spatial.boxes_meet("a", "b")).collect()] == [True, False]


def test_bulk_insert_numbers_from_one(spark):
    stories = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "story int, blocks array<string>")
    assert [tuple(r) for r in content.bulk_insert(stories, "blocks").collect()] == [(1, "x", 1), (1, "y", 2)]


def test_zones_without_any_match(spark):
    zones = spark.createDataFrame([("A",), ("B",)], "code string")
    values = spark.createDataFrame([("A", 1.0), ("C", 2.0), ("B", None)], "code string, v double")
    assert {r.code: r.v for r in tabular.with_values(zones, values, "code", "v").collect()} == {"A": 1.0, "B": None}
    assert tabular.with_values(zones, values.where("code = 'C'"), "code", "v") is None
    assert tabular.with_shares(zones, values, "code").count() == 2
    with pytest.raises(ValueError, match="no zone"):
        tabular.with_shares(zones, values.where("code = 'C'"), "code")
