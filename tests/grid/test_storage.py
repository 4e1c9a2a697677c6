import sqlite3

import pytest

from cellward.sources import storage


def test_read_or_build(spark, tmp_path):
    path, calls = f"{tmp_path}/t", []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert storage.read_or_build(spark, path, build).count() == 3
    assert len(calls) == 1
    assert storage.first_existing(spark, [f"{tmp_path}/none", path]) == path
    with pytest.raises(FileNotFoundError):
        storage.first_existing(spark, [f"{tmp_path}/none"])


@pytest.mark.parametrize("names", [("tiles", "zoom_level, tile_column, tile_row, tile_data"), ("map", "z, x, y, data")])
def test_mbtiles(spark, tmp_path, names):
    table, columns = names
    db = sqlite3.connect(tmp_path / "a.mbtiles")
    db.execute("create table metadata(name text, value text)")
    db.execute("insert into metadata values ('minzoom', '6')")
    db.execute(f"create table {table}({columns})")
    db.executemany(f"insert into {table} values (?, ?, ?, ?)", [(6, 1, 2, b"a"), (7, 3, 4, b"b")])
    db.commit()
    db.close()
    metadata, tiles = storage.mbtiles(spark, f"{tmp_path}/a.mbtiles")
    assert [(r.name, r.value) for r in metadata.collect()] == [("minzoom", "6")]
    assert sorted((r.zoom_level, r.tile_column, r.tile_row, bytes(r.tile_data)) for r in tiles.collect()) == [(6, 1, 2, b"a"), (7, 3, 4, b"b")]


def test_layers_and_csv(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 0.5, "a", "gdp"), (0, 1, float("nan"), "b", "gdp")], "row int, col int, v double, scenario string, indicator string")
    storage.write_layers(cells, f"{tmp_path}/l")
    assert sorted(tuple(r) for r in storage.layers(spark, f"{tmp_path}/l").collect()) == [("a", "gdp"), ("b", "gdp")]
    assert storage.drop_missing(cells).where("v is null").count() == 1
    storage.write_csv(cells.drop("v"), f"{tmp_path}/c")
    assert storage.read_csv(spark, f"{tmp_path}/c", "row int, col int, scenario string, indicator string").count() == 2
    assert not storage.write_exposition(cells.where("scenario = 'c'"), "v", f"{tmp_path}/e")
    with pytest.raises(ValueError):
        storage.require_columns(cells, ["x"])
