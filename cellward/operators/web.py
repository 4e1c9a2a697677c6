"""What the map and story pages ask of tables: visible layers, tile gates, listings with side data, formats of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellward.operators import lines, spatial
from cellward.sources.storage import cut, sized


def visible(layers: DataFrame, groups: DataFrame, scenario: str, indicator: str) -> DataFrame:
    """Layers (layer_id) with ``visible``: in the chosen group's list, or among its chosen indicator's layers.

    groups: group_id, layer_ids, indicators (a map of indicator to {layers, cluster_layer}).
    """
    chosen = groups.where(F.col("group_id") == scenario)
    own = chosen.select(F.explode("layer_ids").alias("layer_id"))
    more = chosen.select(F.try_element_at("indicators", F.lit(indicator)).alias("i")).where("i is not null")
    more = more.select(F.explode(F.array_append("i.layers", F.col("i.cluster_layer"))).alias("layer_id"))
    shown = own.union(more).distinct().withColumn("visible", F.lit(True))
    return layers.join(shown, "layer_id", "left").withColumn("visible", F.coalesce("visible", F.lit(False)))


def indicator_keys(groups: DataFrame, indicators: str) -> DataFrame:
    """The different keys of the groups' maps."""
    return groups.select(F.explode(F.map_keys(indicators)).alias("indicator")).distinct()


def status_counts(entries: Column) -> tuple[Column, Column, Column]:
    """Entries of an array by status."""
    n = lambda status: F.size(F.filter(entries, lambda x: F.coalesce(x["status"] == status, F.lit(False))))
    return n("success"), n("warning"), n("danger")


def without(attributes: Column, hidden: tuple[str, ...]) -> Column:
    """A map without the hidden keys and empty values."""
    return F.map_filter(attributes, lambda k, v: ~k.isin(*hidden) & v.isNotNull() & (v != ""))


def tiles_inside(asked: DataFrame, low: Column, high: Column, bounds: Column) -> DataFrame:
    """Tiles (z, x, y) of a zoom within [low, high] that touch the bounds (west, south, east, north); null bounds bound nothing."""
    box = asked.where(F.col("z").between(low, high)).select("*", *spatial.tile_bounds(F.col("z"), F.col("x"), F.col("y")))
    apart = (F.col("east") < bounds[0]) | (F.col("west") > bounds[2]) | (F.col("north") < bounds[1]) | (F.col("south") > bounds[3])
    return box.where(~F.coalesce(apart, F.lit(False))).select(*asked.columns)


def advice(n_tiles: Column, bounds: Column, max_zoom: Column, zooms: Column) -> Column:
    """what to look at in a tile database; zooms is an array, null if unknown."""
    rules = (
        ("few tiles", n_tiles < 100),
        ("default bounds", bounds == "-15,30,35,75"),
        ("low maximum zoom", F.coalesce(max_zoom.try_cast("int"), F.lit(12)) < 12),
        ("no high zoom", F.array_max(zooms) < 10),
        ("few zooms", F.coalesce(F.size(zooms), F.lit(0)) < 6),
    )
    return F.filter(F.array(*(F.when(bad, name) for name, bad in rules)), lambda x: x.isNotNull())


def with_unit(value: Column, unit: Column) -> Column:
    """millions as M, thousands as K for tonnes and persons, whole numbers with separators otherwise."""
    plain = F.format_number(value, 0)
    short = F.when(value >= 1_000_000, F.format_string("%.1fM", value / 1_000_000)).when(value >= 1_000, F.format_string("%.0fK", value / 1_000)).otherwise(plain)
    return F.when(unit.isin("t", "persons"), F.concat_ws(" ", short, unit)).when(unit == "€M", F.concat_ws(" ", plain, unit)).otherwise(plain)


def change_percent(now: Column, projected: Column) -> Column:
    """change in percent of the present value; null where that is 0."""
    return F.try_divide((projected - now) * 100.0, now)


def parts_of(path: Column) -> tuple[Column, Column, Column]:
    """parent folder, stem and extension of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1))


def named(files: DataFrame, layer: str) -> DataFrame:
    """Q-C15: the files of a layer, by base name or file name."""
    name = F.element_at(F.split("key", "/"), -1)
    return files.where((name == layer) | (F.regexp_replace(name, r"(?<=.)\.[^.]*$", "") == layer))


def with_side_data(images: DataFrame, side: DataFrame) -> DataFrame:
    """Images (key) with their side data (stem, category, scenario, title) by stem; the path's folders are the defaults, K13's merge."""
    parts = F.split("key", "/")
    own = images.withColumns({"stem": parts_of(F.col("key"))[1], "path_category": F.try_element_at(parts, F.lit(2)), "path_scenario": F.try_element_at(parts, F.lit(3))})
    full = own.join(side, "stem", "left")
    return full.select("key", F.coalesce("category", "path_category").alias("category"), F.coalesce("scenario", "path_scenario").alias("scenario"), "title")


def paired_files(files: DataFrame, source: str, target: str) -> DataFrame:
    """Files of one extension with the file of another extension of the same folder and stem."""
    folder, stem, ext = parts_of(F.col("key"))
    rows = files.select("key", folder.alias("folder"), stem.alias("stem"), ext.alias("ext"))
    left, right = rows.where(F.col("ext") == source), rows.where(F.col("ext") == target)
    return left.select(F.col("key").alias("original"), "folder", "stem").join(right.select(F.col("key").alias("converted"), "folder", "stem"), ["folder", "stem"]).select("original", "converted")


def export_ok(west: Column, south: Column, east: Column, north: Column) -> Column:
    """K5: whether bounds may be exported: degrees in range, at least 0.001 and at most 350 by 170 of them."""
    inside = west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90)
    wide, tall = east - west, north - south
    return F.coalesce(inside & (wide >= 0.001) & (tall >= 0.001) & (wide <= 350) & (tall <= 170), F.lit(False))


def cache_statistics(entries: DataFrame) -> DataFrame:
    """Entries, hits, misses, hit rate and bytes of each type of a manifest (type, hits, misses, size)."""
    out = entries.groupBy("type").agg(F.count(F.lit(1)).alias("entries"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("size").alias("bytes"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits") * 1.0, F.col("hits") + F.col("misses")), F.lit(0.0)))


def invalid(entries: DataFrame, part: str | None = None, days: int | None = None, kind: str | None = None, today: Column | None = None) -> DataFrame:
    """Q-C17: the entries to drop: whose key holds a part, older than some days (F35), of a type."""
    hit = F.lit(True)
    if part is not None:
        hit = hit & F.col("key").contains(part)
    if days is not None:
        hit = hit & (F.datediff(today if today is not None else F.current_date(), "created") > days)
    if kind is not None:
        hit = hit & (F.col("type") == kind)
    return entries.where(hit)


def total_within(values: DataFrame, value: str, expected: float, tolerance: float) -> DataFrame:
    """A sum, its deviation from the expected one in percent, and whether that is within the tolerance."""
    out = values.agg(F.sum(value).alias("total")).withColumn("deviation", (F.col("total") - expected) * 100.0 / expected)
    return out.withColumn("ok", F.abs("deviation") <= tolerance)


def by_prefix(df: DataFrame, name: str, prefix: str, total: Column | None = None) -> DataFrame:
    """Rows whose name begins with the prefix in any case, without those of a total."""
    out = df.where(F.lower(name).startswith(prefix.lower()))
    return out if total is None else out.where(~F.coalesce(total, F.lit(False)))


def outputs_of(df: DataFrame, file: str, indicators: list[str], without: list[str]) -> DataFrame:
    """Output files of some indicators, without the parts of one."""
    low = F.lower(file)
    return df.where(low.rlike(f"_({'|'.join(indicators)})") & ~low.rlike("|".join(without)))


def meets_box(ring: str, west: float, south: float, east: float, north: float) -> Column:
    """Whether a ring's polygon and a box have a point in common: a side that meets the box, or the box inside the ring."""
    corners = ((west, south), (east, south), (east, north), (west, north))
    turns = ", ".join(f"(b.x - a.x) * ({y!r}D - a.y) - (b.y - a.y) * ({x!r}D - a.x)" for x, y in corners)
    near = f"least(a.x, b.x) <= {east!r}D and greatest(a.x, b.x) >= {west!r}D and least(a.y, b.y) <= {north!r}D and greatest(a.y, b.y) >= {south!r}D"
    side = F.expr(f"exists(zip_with({ring}, concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1)), (a, b) -> {near} and least({turns}) <= 0 and greatest({turns}) >= 0), h -> h)")
    return F.when(F.size(ring) > 0, side | spatial.contains(ring, f"{west!r}D", f"{south!r}D")).otherwise(False)


def exportable(shapes: DataFrame, layer: str, tile: float, box: tuple[float, float, float, float] = (-20.0, 30.0, 45.0, 75.0), key: str = "id", ring: str = "ring") -> DataFrame:
    """K5: the shapes that an export holds: all of a layer whose bounds are good; else its valid shapes that meet the box (west, south, east, north).

    A layer of which nothing is left has no rows.  Shapes without a ring stay in good layers only; rows with a null layer are a layer of their own.
    """
    layered = shapes.withColumn("__layer", F.struct(F.col(layer).alias("name")))
    ends = layered.select("__layer", *spatial.bounds(ring)).groupBy("__layer").agg(*(getattr(F, n.split("_")[0])(n).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")))
    judged = sized(ends.select("__layer", export_ok(*(F.col(n) for n in ("min_x", "min_y", "max_x", "max_y"))).alias("__ok")))
    good = layered.join(judged.where("__ok"), "__layer", "left_semi")
    bad = cut(layered.join(judged.where("not __ok"), "__layer", "left_semi").where(meets_box(ring, *box)))
    valid = bad.join(lines.faults(bad, tile, key, ring).select(key), key, "left_anti")
    return good.unionByName(valid).drop("__layer")
