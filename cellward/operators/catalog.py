"""Layer names, the layer catalogue, and tile look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellward.operators.spatial import tile_bounds, tms_flip
from cellward.operators.tabular import ordinal
from cellward.sources.storage import feature

#: Keyword in a layer's name to indicator, first match.
INDICATORS = (("freight", "Freight"), ("gdp", "GDP"), ("hrst", "HRST"), ("population", "Population"), ("combined", "Combined"))
#: The order in which groups are shown; what has no indicator comes last.
SHOWN, OTHER = ("Combined", "Freight", "Population", "HRST", "GDP"), "Other Layers"

#: Colours, bounds (west, south, east, north) and value range by type.  Colours of ports are those of "unknown".
COLOURS = {
    "risk": ("#ffffff", "#ffff00", "#ffa500", "#ff0000"),
    "hazard": ("#add8e6", "#00bfff", "#0000ff", "#00008b"),
    "exposition": ("#ffffff", "#90ee90", "#228b22", "#006400"),
    "relevance": ("#ffffff", "#ffd700", "#ff8c00", "#ff4500"),
    "clusters": ("#ffffff", "#4fc3f7", "#2196f3", "#0d47a1"),
    "sea-level-rise": ("#ffffff", "#81c784", "#4caf50", "#1b5e20"),
    "nuts": ("#ffffff", "#4fc3f7", "#2196f3", "#0d47a1"),
    "unknown": ("#ffffff", "#ff6b6b", "#e53935", "#b71c1c"),
}
REGION, WORLD = (3.5, 51.2, 7.2, 53.5), (-180.0, -90.0, 180.0, 90.0)
RANGES = {"risk": (0, 1), "hazard": (0, 1), "exposition": (0, 100), "relevance": (0, 100), "clusters": (0, 500), "sea-level-rise": (0, 3), "nuts": (0, 500), "port": (0, 500), "unknown": (0, 100)}


def stem(name: Column) -> Column:
    """Without the extension and a time stamp in front."""
    return F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"^\d+_(?=.)", "")


def layer_id(name: Column) -> Column:
    """cluster layers get a short lower-case id; names that the pattern doesn't fit keep their stem."""
    pattern = r"clusters_SLR-(\d+)-(\w+)_(\w+)"
    part = lambda i: F.lower(F.regexp_extract(name, pattern, i))
    return F.when(name.rlike(pattern), F.concat_ws("-", F.lit("clusters-slr"), part(2), part(3))).otherwise(stem(name))


def scenario_of(name: Column) -> Column:
    """the scenario of a risk file's name; what follows it after _ is ``rest_of``."""
    return F.regexp_extract(name, r"(SLR-\d+-[^_.]+)", 1)


def rest_of(name: Column) -> Column:
    """what stands between the scenario and the extension."""
    return F.regexp_extract(name, r"SLR-\d+-[^_.]+_([^.]+)", 1)


def display_name(name: Column) -> Column:
    """of a layer id; blanks for _ and -, each word with a capital, three abbreviations whole."""
    words = F.regexp_extract_all(F.regexp_replace(name, "[_-]", " "), F.lit(r"\w+|\W+"), F.lit(0))
    out = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")
    for word in ("Slr", "Gdp", "Hrst"):
        out = F.regexp_replace(out, rf"\b{word}\b", word.upper())
    return F.trim(out)


#: Type, and how the lower-case file name tells it: prefix, part.  The first that fits counts.
TYPES = (
    ("clusters", None, "cluster"),
    ("risk", "risk_", "_risk_"),
    ("hazard", "hazard_", "_hazard_"),
    ("exposition", "exposition_", "_exposition_"),
    ("relevance", "relevance_", "_relevance_"),
    ("sea-level-rise", None, "slr"),
    ("nuts", "nuts", "_nuts"),
    ("port", "port", "_port_"),
)


def layer_type(name: Column) -> Column:
    """F8."""
    low, out = F.lower(name), F.lit("unknown")
    for kind, prefix, part in reversed(TYPES):
        fits = low.contains(part) | low.startswith(prefix) if prefix else low.contains(part)
        out = F.when(fits, kind).otherwise(out)
    return out


def file_format(name: Column) -> Column:
    """by extension; null for files that no layer comes from."""
    return F.when(name.endswith(".cog") | name.endswith(".tif"), "cog").when(name.endswith(".mbtiles"), "mbtiles")


def data_type(name: Column) -> Column:
    """raster or vector; tile files by their name, then by their type."""
    kind = layer_type(name)
    vector = name.startswith("clusters_") | name.contains("clusters_SLR")
    raster = name.startswith("risk_") | name.startswith("hazard_") | name.startswith("exposition_") | name.startswith("relevance_")
    tiles = F.when(vector, "vector").when(raster, "raster").when(kind.isin("clusters", "nuts", "port"), "vector").otherwise("raster")
    return F.when(file_format(name) == "cog", "raster").when(file_format(name) == "mbtiles", tiles)


#: Parts of a layer's name and its place in the stack, first match; then by data type.
STACK = ((("nuts", "administrative", "boundary"), 10), (("exposition", "exposure"), 20), (("relevance",), 30), (("hazard",), 40), (("risk",), 50), (("cluster",), 60))
STACK_VECTOR, STACK_RASTER = 45, 25


def z_index(name: Column, kind: Column) -> Column:
    """by the shown name, else by data type."""
    low, out = F.lower(name), F.when(kind == "vector", STACK_VECTOR).otherwise(STACK_RASTER)
    for words, z in reversed(STACK):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, z).otherwise(out)
    return out


def defaults(kind: Column) -> tuple[Column, Column, Column]:
    """colours, bounds and value range of a type; those of "unknown" for others."""

    def by(table: dict, rest):
        out = F.array(*map(F.lit, rest))
        for k, v in table.items():
            out = F.when(kind == k, F.array(*map(F.lit, v))).otherwise(out)
        return out

    known = [k for k in RANGES if k != "unknown"]
    return by(COLOURS, COLOURS["unknown"]), by(dict.fromkeys(known, REGION), WORLD), by(RANGES, RANGES["unknown"])


def indicator(name: Column) -> Column:
    """first keyword found."""
    low, out = F.lower(name), F.lit(OTHER)
    for word, label in reversed(INDICATORS):
        out = F.when(low.contains(word), label).otherwise(out)
    return out


def rise(name: Column) -> Column:
    """SLR n, or No SLR."""
    n = F.regexp_extract(F.lower(name), r"slr[-\s]?(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("SLR "), n)).otherwise("No SLR")


def catalogue(files: DataFrame, styles: DataFrame) -> DataFrame:
    """Q-C8, J16, J18, O5: one row for each layer id (its first file), with derived attributes and its style, ready to be ordered by z and name.

    Files of other formats are left out.
    """
    key = F.col("key")
    rows = files.where(file_format(key).isNotNull()).withColumn("layer_id", layer_id(key)).groupBy("layer_id").agg(F.min("key").alias("key"))
    colours, bounds, values = defaults(F.col("layer_type"))
    rows = rows.withColumns({"layer_type": layer_type(key), "data_type": data_type(key), "format": file_format(key), "name": display_name(F.col("layer_id"))})
    rows = rows.withColumns({"colours": colours, "bounds": bounds, "value_range": values, "default_z": z_index(F.col("name"), F.col("data_type"))})
    return rows.join(styles, "layer_id", "left").withColumn("z", F.coalesce("z", "default_z")).drop("default_z")


def renumbered(df: DataFrame, order: list) -> DataFrame:
    """Z order 10, 20, 30 and so on."""
    return ordinal(df, order, "z_index").withColumn("z_index", (F.col("z_index") * 10 + 10).cast("int"))


def grouped(df: DataFrame, name: str) -> DataFrame:
    """Layers by indicator, then by sea-level rise, with the ranks in which both are shown."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(SHOWN) for x in (k, i)])
    rows = df.select(name, indicator(F.col(name)).alias("indicator"), rise(F.col(name)).alias("rise"))
    rows = rows.withColumn("rise", F.when(F.col("indicator") == OTHER, F.lit("")).otherwise(F.col("rise")))
    out = rows.groupBy("indicator", "rise").agg(F.sort_array(F.collect_list(name)).alias("layers"))
    step = F.coalesce(F.regexp_extract("rise", r"(\d+)", 1).try_cast("int"), F.lit(-1))
    return out.withColumn("indicator_rank", F.coalesce(F.try_element_at(order, F.col("indicator")), F.lit(len(SHOWN)))).withColumn("rise_rank", step)


def covering_tile(asked: DataFrame, tiles: DataFrame, least: int = 6) -> DataFrame:
    """For each asked z, x, y the tile at the highest zoom from z down to ``least`` that covers it.

    Asked rows are exploded to their ancestors, at most z - least + 1 each, and met by equality.
    """
    up = asked.withColumn("zoom", F.explode(F.sequence(F.lit(least), F.col("z"))))
    part = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("z") - F.col("zoom"))).cast("long")
    up = up.withColumn("tx", part("x")).withColumn("ty", part("y"))
    hit = up.join(tiles.select(F.col("z").alias("zoom"), F.col("x").alias("tx"), F.col("y").alias("ty"), "data"), ["zoom", "tx", "ty"])
    best = hit.groupBy("z", "x", "y").agg(F.max_by("data", "zoom").alias("data"), F.max("zoom").alias("found_zoom"))
    return asked.join(best, ["z", "x", "y"], "left")


def either_order(asked: DataFrame, tiles: DataFrame) -> DataFrame:
    """a tile by bottom-up row number first, then by top-down."""
    flipped = asked.withColumn("flip", tms_flip(F.col("z"), F.col("y")))
    tms = tiles.select(F.col("z"), F.col("x"), F.col("y").alias("flip"), F.col("data").alias("tms"))
    xyz = tiles.select("z", "x", "y", F.col("data").alias("xyz"))
    return flipped.join(tms, ["z", "x", "flip"], "left").join(xyz, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("tms", "xyz").alias("data"))


def tile_statistics(tiles: DataFrame) -> DataFrame:
    """Tiles and their extent at each zoom."""
    return tiles.groupBy("z").agg(F.count(F.lit(1)).alias("n_tiles"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


#: Content types by a tile database's format.
FORMATS = {"pbf": "application/x-protobuf", "mvt": "application/x-protobuf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def content_type(data: Column, form: Column | None = None) -> Column:
    """by the metadata's format, else by the first bytes of data of 8 bytes or more; vector tiles otherwise."""
    head, long = F.hex(F.substr(data, F.lit(1), F.lit(12))), F.octet_length(data) >= 8
    guess = F.when(long & head.startswith("89504E47"), "image/png").when(long & head.startswith("FFD8"), "image/jpeg")
    guess = guess.when(long & head.startswith("52494646") & (F.substr(head, F.lit(17), F.lit(8)) == "57454250"), "image/webp").otherwise("application/x-protobuf")
    if form is None:
        return guess
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(form)), guess)


def parsed_bounds(text: Column) -> Column:
    """"w,s,e,n" as four numbers."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))


def cache_key(*parts: Column) -> Column:
    """F32."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def tile_coverage(tiles: DataFrame, metadata: DataFrame, most: int = 5) -> DataFrame:
    """Q-C12: (file, n_tiles, k, z, x, y, bounds, scenario, risk_type, feature): what each tile file covers, as GeoJSON features.

    tiles: file, z, x, y; metadata: a row for each file with its bounds as text, "w,s,e,n".  The first ``most`` tiles of a file by zoom, column and
    row are its features.  A file without tiles has one, of its metadata's bounds, or of the world if these aren't four numbers.
    Scenario and kind of risk are read from names of cluster files and are "unknown" for others.
    """
    counts = tiles.groupBy("file").agg(F.count(F.lit(1)).alias("n_tiles"))
    first = Window.partitionBy("file").orderBy("z", "x", "y")
    shown = tiles.select("file", "z", "x", "y").withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    west, south, east, north = tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    shown = shown.withColumn("bounds", F.array(west, south, east, north)).join(counts, "file")
    given = parsed_bounds(F.col("bounds"))
    usable = F.coalesce((F.size(given) == 4) & ~F.exists(given, lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    world = F.array(*(F.lit(float(v)) for v in (-180, -90, 180, 90)))
    bare = metadata.join(counts, "file", "left_anti").select("file", F.when(usable, given).otherwise(world).alias("bounds"), F.lit(0).cast("long").alias("n_tiles"), F.lit(1).alias("k"))
    rows = shown.unionByName(bare, allowMissingColumns=True)
    name = lambda i: F.lower(F.regexp_extract("file", r"clusters_SLR-(\d+)-(\w+)_(\w+)", i))
    rows = rows.withColumns({"scenario": F.when(name(2) == "", "unknown").otherwise(name(2)), "risk_type": F.when(name(3) == "", "unknown").otherwise(name(3))})
    at = lambda x, y: F.array(F.col("bounds")[x], F.col("bounds")[y])
    outline = F.array(at(0, 3), at(2, 3), at(2, 1), at(0, 1), at(0, 3))
    rows = rows.withColumn("geometry", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(outline).alias("coordinates"))))
    return rows.select("file", "n_tiles", "k", "z", "x", "y", "bounds", "scenario", "risk_type", feature("geometry", ["file", "scenario", "risk_type", "z", "x", "y"]).alias("feature"))
