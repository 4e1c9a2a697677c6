"""Clusters of risk of all risk files at once: which files, their cells, their clusters with statistics, and features.

The files' grids lie one below the other in one tall grid, far enough apart that nothing reaches from one to the next, so
the operators on cells work on all files in the same jobs, and a file is never a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellward.operators import clusters, outlines, raster, spatial
from cellward.plans.config import ClusterSettings
from cellward.sources.storage import cut, feature, shuffled, sized

#: Metres of side of a mask's area for each cell of the closing's radius.
SIDE_PER_CELL = 600


def wanted(name: Column) -> Column:
    """Whether a risk file gets clusters: those of gdp, of population, and of freight as a whole; null names don't."""
    low = F.lower(name)
    return F.coalesce(low.rlike("_gdp|_population") | (low.contains("_freight") & ~low.rlike("_loading|_unloading")), F.lit(False))


def parts_of(name: Column) -> tuple[Column, Column]:
    """Scenario and indicator of a risk file's name; without a scenario the whole name stands for it, and the indicator is empty."""
    stem = F.replace(F.replace(name, F.lit(".tif"), F.lit("")), F.lit("risk_"), F.lit(""))
    scenario = F.regexp_extract(stem, r"^(SLR-\d+-[^_]+)", 1)
    return F.when(scenario == "", stem).otherwise(scenario), F.regexp_extract(stem, r"^SLR-\d+-[^_]+_(.+)$", 1)


def masks(cells: DataFrame, rows: int, cols: int, settings: ClusterSettings, tile: int = raster.TILE) -> DataFrame:
    """(file, row, col) of the cells in the closed mask of each file; files with fewer than the minimum of samples have none.

    With outlines the closing's radius grows with the side of the file's area over the threshold, and the mask is smoothed
    and cut at a half.  Files of one radius are closed together: there is a pass for each different radius, not for each file.
    """
    own = cells.select("file", "row", "col", F.coalesce(F.col("value") >= settings.risk_threshold, F.lit(False)).alias("hot"))
    own = cut(own.groupBy("file", "row", "col").agg(F.bool_or("hot").alias("hot")))
    least = settings.morphological_closing_disk_size
    area = F.count(F.lit(1)) * settings.cell_size_meters**2
    radius = F.greatest(F.lit(least), F.ceil(F.sqrt(area) / SIDE_PER_CELL).cast("int")) if settings.use_contour_method else F.lit(least)
    sizes = sized(own.where("hot").groupBy("file").agg(radius.alias("radius")))
    found = None
    for size in sorted(r[0] for r in sizes.select("radius").distinct().collect()):
        layer = own.join(F.broadcast(sizes.where(F.col("radius") == size).select("file")), "file", "left_semi")
        done = raster.closing(layer, "hot", rows, cols, size, "inside", tile, ("file",))
        if settings.use_contour_method:
            done = raster.gaussian(done.withColumn("v", F.col("inside").cast("double")), "v", rows, cols, size / 2, "nearest", "v", tile, ("file",)).withColumn("inside", F.col("v") >= 0.5)
        done = done.where("inside").select("file", "row", "col")
        found = done if found is None else found.unionByName(done)
    if found is None:
        return own.limit(0).select("file", "row", "col")
    found = cut(found)
    enough = found.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings.minimum_samples).select("file")
    return found.join(F.broadcast(enough), "file", "left_semi")


def extracted(cells: DataFrame, rows: int, cols: int, settings: ClusterSettings, tile: int = raster.TILE) -> DataFrame:
    """(file, row, col, risk_cluster_id) of all files' clusters, numbered from 0 within each file.

    cells: file, row, col, value over grids of ``rows`` by ``cols``; a missing or null value is under every threshold, and of a cell that is
    listed twice one listing over the threshold counts.  Files that aren't ``wanted``, and files without clusters, have no rows.
    With outlines a cluster is what touches along edges, with its small holes filled.  Without, it is a density cluster of
    at least three cells.  Clusters under the least area are left out.  Ids follow the clusters' first cells in row order.
    """
    inside = cut(masks(cells.where(wanted(F.col("file"))), rows, cols, settings, tile))
    stride = rows + 2 + int(settings.cluster_epsilon_multiplier)
    names = [r[0] for r in inside.select("file").distinct().orderBy("file").collect()]
    if not names:
        return inside.select("file", "row", "col", F.lit(0).alias("risk_cluster_id"))
    order = F.broadcast(cells.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "file_no int, file string"))
    tall = inside.join(order, "file").select((F.col("row") + F.col("file_no") * stride).alias("row"), "col")
    res = settings.cell_size_meters
    if settings.use_contour_method:
        found = outlines.finalised(tall, settings.hole_area_threshold, settings.minimum_polygon_area_square_meters, res, tile)
    else:
        key = F.col("row").cast("long") * F.lit(1 << 32) + F.col("col")
        points = cut(tall.select(key.alias("id"), "row", "col", (F.col("col") * 1.0).alias("x"), (F.col("row") * 1.0).alias("y")))
        dense = cut(shuffled(points).join(clusters.dbscan(points.select("id", "x", "y"), settings.cluster_epsilon_multiplier, settings.minimum_samples).where("cluster is not null"), "id"))
        sizes = dense.groupBy("cluster").agg((F.count(F.lit(1)) * res * res).alias("area"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        large = clusters.numbered(sizes.where("n >= 3"), settings.minimum_polygon_area_square_meters, ["first"])
        found = dense.join(sized(large.select("cluster", "risk_cluster_id")), "cluster")
    found = cut(found.select("row", "col", "risk_cluster_id", F.floor(F.col("row") / stride).cast("int").alias("file_no")))
    first = F.broadcast(found.groupBy("file_no").agg(F.min("risk_cluster_id").alias("first")))  # a row for each file
    numbered = found.join(first, "file_no").join(order, "file_no")
    return numbered.select("file", (F.col("row") - F.col("file_no") * stride).cast("int").alias("row"), "col", (F.col("risk_cluster_id") - F.col("first")).cast("int").alias("risk_cluster_id"))


def described(found: DataFrame, cells: DataFrame, res: float) -> DataFrame:
    """Each cluster with its file's scenario and indicator and the statistics of the positive values in its cells.

    Filled cells count into the area, also where the file has no value.
    """
    value = cells.groupBy("file", "row", "col").agg(F.max("value").alias("value"))
    joined = found.join(shuffled(value), ["file", "row", "col"], "left").withColumn("key", F.struct("file", "risk_cluster_id"))
    stats = spatial.zonal(joined, "key", "value", res)
    scenario, indicator = parts_of(F.col("key.file"))
    return stats.select("key.file", "key.risk_cluster_id", scenario.alias("scenario"), indicator.alias("indicator"), "pixel_count", "mean_risk", "max_risk", "area", "density")


def features(found: DataFrame, x0: float, y0: float, res: float, rows: int, tile: int = raster.TILE) -> DataFrame:
    """(file, risk_cluster_id, feature): each cluster as a GeoJSON polygon or, of several parts, multipolygon with holes, rings closed.

    Write it parted by file for one export a file.  Here a cluster's outline is a row, and it takes its own points.
    """
    stride = rows + 2
    names = [r[0] for r in found.select("file").distinct().orderBy("file").collect()]
    order = F.broadcast(found.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "file_no int, file string"))
    tall = cut(found.join(order, "file").select((F.col("row") + F.col("file_no") * stride).cast("int").alias("row"), "col", F.col("risk_cluster_id").cast("long").alias("label"), "file_no"))
    parted = cut(outlines.regions(tall.select("row", "col", "label"), tile))
    owner = parted.groupBy("region").agg(F.min("label").alias("risk_cluster_id"), F.floor(F.min("row") / stride).cast("int").alias("file_no"))
    shapes = outlines.polygons(outlines.ring_pieces(parted, tile)).join(owner, "region")

    def ring(points: Column) -> Column:
        place = lambda p: F.array(F.lit(x0) + p["x"] * res, F.lit(y0) - (p["y"] - F.col("file_no") * stride) * res)
        return F.transform(F.concat(points, F.slice(points, 1, 1)), place)

    shapes = shapes.select("file_no", "risk_cluster_id", "region", F.concat(F.array(ring(F.col("outer"))), F.transform("holes", ring)).alias("rings"))
    whole = shapes.groupBy("file_no", "risk_cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("region", "rings"))), lambda s: s["rings"]).alias("parts"))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.element_at("parts", 1).alias("coordinates")))
    more = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts").alias("coordinates")))
    shown = whole.join(order, "file_no").withColumn("geometry", F.when(F.size("parts") == 1, one).otherwise(more)).withColumn("risk_cluster_id", F.col("risk_cluster_id").cast("int"))
    return shown.select("file", "risk_cluster_id", feature("geometry", ["file", "risk_cluster_id"]).alias("feature"))
