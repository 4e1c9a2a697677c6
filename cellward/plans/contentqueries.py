"""Queries on statistical tables, layer names, tiles, stories and references.

Conversations stand for stories (a turn is a block), parts and suppliers for named things, orders for statistics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellward.operators import catalog, content, spatial, tabular
from cellward.sources.storage import feature, table
from cellward.streaming import events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, and the SQL that checks it if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT o_orderkey, o_orderpriority AS geo, year(o_orderdate) AS period, TRY_CAST(CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS v, o_orderstatus AS unit FROM orders),
f AS (SELECT * FROM s WHERE geo LIKE '1%' AND length(geo) = 8 AND contains(unit, 'F') AND v IS NOT NULL) SELECT o_orderkey, CAST(period AS INTEGER) AS period, v FROM f WHERE period = (SELECT max(period) FROM f)""")
def latest_period_filter(spark, d):
    """P1 to P7, W4."""
    text = F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string"))
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("geo"), F.year("o_orderdate").alias("period"), tabular.number(text).alias("v"), F.col("o_orderstatus").alias("unit"))
    return tabular.latest(tabular.regional(s, "geo", "1", 8, "unit", "F").na.drop("any"), "period").select("o_orderkey", "period", "v")


@query("""WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2021*' WHEN 1 THEN '2023*' WHEN 2 THEN '2024 4e kwartaal*' ELSE '2024' END AS label FROM orders) SELECT o_orderkey, label FROM p WHERE label = '2023*'""")
def starred_period(spark, d):
    """Without the wanted label the last yearly one with a star."""
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, "2021*").when(k == 1, "2023*").when(k == 2, "2024 4e kwartaal*").otherwise("2024")
    return tabular.starred_period(table(spark, d, "orders").select("o_orderkey", label.alias("label")), "label")


@query("""WITH l AS (SELECT c_nationkey AS zone, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY 1),
u AS (SELECT s_nationkey AS zone, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * 1000 ELSE l_quantity END) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0 GROUP BY 1)
SELECT zone, coalesce(l.v, 0.0) AS loading, coalesce(u.v, 0.0) AS unloading, coalesce(l.v, 0.0) + coalesce(u.v, 0.0) AS v, 'T' AS unit FROM l FULL JOIN u USING (zone) WHERE coalesce(l.v, 0.0) + coalesce(u.v, 0.0) > 0""")
def freight_unified(spark, d):
    """J4, P4, P8, S8, U2."""
    line = table(spark, d, "lineitem")
    left = line.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_acctbal > 9000")
    left = left.groupBy(F.col("c_nationkey").alias("zone")).agg(F.sum("l_quantity").alias("v"))
    right = line.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("s_acctbal < 0")
    right = right.groupBy(F.col("s_nationkey").alias("zone")).agg(F.sum(tabular.tonnes(F.col("l_quantity"), F.when(F.col("l_returnflag") == "A", "THS_T").otherwise("T"))).alias("v"))
    return tabular.outer_sum(left, right, ["zone"], "v")


@query("WITH m AS (SELECT * FROM (VALUES ('FRANCE', 'FR24'), ('GERMANY', 'DE24')) v(old, new)) SELECT n_name, coalesce(new, n_name) AS code FROM nation LEFT JOIN m ON n_name = old")
def code_remap(spark, d):
    """J3."""
    mapping = spark.createDataFrame([("FRANCE", "FR24"), ("GERMANY", "DE24")], "old string, new string")
    return tabular.remap(table(spark, d, "nation").select("n_name"), "n_name", mapping, "code")


@query("""WITH f AS (SELECT s_nationkey AS zone, sum(l_quantity) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), a AS (SELECT s_nationkey AS zone, sum(greatest(s_acctbal, 0.0)) AS sa, count(*) AS n FROM supplier GROUP BY 1)
SELECT s_suppkey AS id, zone, round(CASE WHEN sa > 0 THEN total * greatest(s_acctbal, 0.0) / sa ELSE total / n END, 4) AS value FROM supplier JOIN f ON s_nationkey = f.zone JOIN a USING (zone)""")
def port_area_allocation(spark, d):
    """A1 to A3, J5, W2."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("zone"), F.greatest("s_acctbal", F.lit(0.0)).alias("e"))
    total = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("q")).join(s, "id").groupBy("zone").agg(F.sum("q").alias("total"))
    return tabular.share_out(s, "zone", "e", total, "total", "value").select("id", "zone", F.round("value", 4).alias("value"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 40 < 2 AND c_nationkey % 3 > 0)")
def missing_zone_report(spark, d):
    """J21, J2."""
    return table(spark, d, "nation").join(table(spark, d, "customer").where("c_custkey % 40 < 2 and c_nationkey % 3 > 0"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select("n_nationkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
def study_area_semi(spark, d):
    """J20, P11, P17."""
    return table(spark, d, "customer").join(table(spark, d, "nation").where("n_regionkey = 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("SELECT c_nationkey AS zone, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_regions(spark, d):
    """The five largest."""
    t = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("zone")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return tabular.top(t, [F.col("total").desc(), F.col("zone")], 5)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_single(spark, d):
    """O2, O4."""
    return tabular.top(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 1)


@query("SELECT n_nationkey AS zone, 'nuts' AS source FROM nation UNION ALL SELECT s_nationkey, 'port' FROM supplier")
def zone_union(spark, d):
    """A bag union with a tag."""
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), F.lit("nuts").alias("source")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("zone"), F.lit("port").alias("source")))


@query("SELECT DISTINCT s_nationkey AS zone FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def indicator_intersect(spark, d):
    """U3, U5."""
    return table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("zone")).intersect(table(spark, d, "customer").where("c_acctbal < 0").select("c_nationkey"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def uncited_except(spark, d):
    """U4."""
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").where("l_quantity > 40"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("SELECT p_partkey, sha256(concat_ws('|', p_name, p_brand, CAST(p_size AS VARCHAR))) AS key FROM part")
def cache_key(spark, d):
    """F32."""
    return table(spark, d, "part").select("p_partkey", catalog.cache_key(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("key"))


@query("""SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def nuts_rollup(spark, d):
    """A17, extended to all levels of the zones; totals are summed by nation before the small joins."""
    t = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    full = t.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = full.rollup("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("t"), 2).alias("total"))
    return out.select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n", "total")


@query("""WITH t AS (SELECT event_id, CAST(6 + event_id % 7 AS INTEGER) AS z, (event_id * 7919) % 64 AS x, (event_id * 104729) % 64 AS y FROM events)
SELECT event_id, round(x / power(2.0::DOUBLE, z) * 360 - 180, 9) AS west, round((x + 1) / power(2.0::DOUBLE, z) * 360 - 180, 9) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / power(2.0::DOUBLE, z))))), 9) AS north,
round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / power(2.0::DOUBLE, z))))), 9) AS south FROM t""")
def tile_bounds(spark, d):
    """G17."""
    t = table(spark, d, "events").select("event_id", (6 + F.col("event_id") % 7).cast("int").alias("z"), (F.col("event_id") * 7919 % 64).alias("x"), (F.col("event_id") * 104729 % 64).alias("y"))
    box = t.select("event_id", *spatial.tile_bounds(F.col("z"), F.col("x"), F.col("y")))
    return box.select("event_id", *(F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")))


@query("""SELECT event_id, CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS y
FROM (SELECT event_id, (event_id * 37 % 3600) / 10.0::DOUBLE - 179.95 AS lon, (event_id * 13 % 1600) / 10.0::DOUBLE - 79.95 AS lat FROM events)""")
def point_tiles(spark, d):
    """F30."""
    t = table(spark, d, "events").select("event_id", (F.col("event_id") * 37 % 3600 / 10.0 - 179.95).alias("lon"), (F.col("event_id") * 13 % 1600 / 10.0 - 79.95).alias("lat"))
    return t.select("event_id", *spatial.tile_of(F.col("lon"), F.col("lat"), F.lit(12)))


def _tiles(spark, d):
    return table(spark, d, "events").groupBy((6 + F.col("event_id") % 3).cast("int").alias("z"), (F.col("event_id") * 7919 % 64).alias("x"), (F.col("event_id") * 31 % 64).alias("y")).agg(F.min("event_id").alias("data"))


_TILES = "tiles AS (SELECT CAST(6 + event_id % 3 AS INTEGER) AS z, event_id * 7919 % 64 AS x, event_id * 31 % 64 AS y, min(event_id) AS data FROM events GROUP BY 1, 2, 3)"
_ASKED = "asked AS (SELECT DISTINCT CAST(8 + event_id % 3 AS INTEGER) AS z, event_id * 17 % 256 AS x, event_id * 11 % 256 AS y FROM events)"


def _asked(spark, d):
    return table(spark, d, "events").select((8 + F.col("event_id") % 3).cast("int").alias("z"), (F.col("event_id") * 17 % 256).alias("x"), (F.col("event_id") * 11 % 256).alias("y")).distinct()


@query(f"""WITH {_TILES}, {_ASKED}, up AS (SELECT a.z, a.x, a.y, t.z AS zoom, data FROM asked a JOIN tiles t ON t.z <= a.z AND t.z >= 6 AND t.x = a.x // (1 << (a.z - t.z)) AND t.y = a.y // (1 << (a.z - t.z)))
SELECT asked.z, asked.x, asked.y, coalesce(b.data, -1) AS data, coalesce(b.found_zoom, -1) AS found_zoom FROM asked LEFT JOIN (SELECT z, x, y, arg_max(data, zoom) AS data, max(zoom) AS found_zoom FROM up GROUP BY 1, 2, 3) b USING (z, x, y)""")
def tile_fallback(spark, d):
    """J19, Q-C9."""
    return catalog.covering_tile(_asked(spark, d), _tiles(spark, d)).na.fill(-1)


@query(f"""WITH {_TILES}, a AS (SELECT z, x, y FROM tiles UNION SELECT z, x, CAST(power(2, z) - 1 - y AS BIGINT) FROM tiles)
SELECT a.z, a.x, a.y, coalesce(t.data, u.data) AS data FROM a LEFT JOIN tiles t ON t.z = a.z AND t.x = a.x AND t.y = CAST(power(2, a.z) - 1 - a.y AS BIGINT) LEFT JOIN tiles u ON u.z = a.z AND u.x = a.x AND u.y = a.y""")
def tile_either_order(spark, d):
    """F28."""
    t = _tiles(spark, d)
    asked = t.select("z", "x", "y").union(t.select("z", "x", spatial.tms_flip(F.col("z"), F.col("y")).alias("y"))).distinct()
    return catalog.either_order(asked, t)


@query(f"WITH {_TILES} SELECT z, count(*) AS n_tiles, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM tiles GROUP BY 1")
def tile_stats(spark, d):
    """A20, A21, Q-C10."""
    return catalog.tile_statistics(_tiles(spark, d))


_COVERED = """names AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 3 THEN 'layer_' ELSE 'clusters_SLR-' || n_nationkey % 4 || '-Severe_' END || n_name AS file,
CASE n_nationkey % 3 WHEN 1 THEN 'none,1,2,3' WHEN 2 THEN (n_nationkey - 20) || ', ' || n_nationkey || ',' || (n_nationkey + 5) || ',' || (n_nationkey + 9) END AS bounds FROM nation)"""


@query(f"""WITH {_TILES}, {_COVERED}, t AS (SELECT file, z, x, y, row_number() OVER (PARTITION BY file ORDER BY z, x, y) AS k, count(*) OVER (PARTITION BY file) AS n_tiles FROM tiles JOIN names ON names.k = data % 20),
b AS (SELECT file, n_tiles, CAST(k AS INTEGER) AS k, z, x, y, x / power(2, z) * 360 - 180 AS west, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / power(2, z))))) AS south, (x + 1) / power(2, z) * 360 - 180 AS east, degrees(atan(sinh(pi() * (1 - 2 * y / power(2, z))))) AS north FROM t WHERE k <= 5
 UNION ALL SELECT file, 0, 1, NULL, NULL, NULL, CASE WHEN k % 3 = 2 THEN k - 20 ELSE -180 END, CASE WHEN k % 3 = 2 THEN k ELSE -90 END, CASE WHEN k % 3 = 2 THEN k + 5 ELSE 180 END, CASE WHEN k % 3 = 2 THEN k + 9 ELSE 90 END FROM names WHERE file NOT IN (SELECT file FROM t)),
m AS (SELECT *, regexp_extract(file, 'clusters_SLR-(\\d+)-(\\w+)_(\\w+)', 2) AS s, regexp_extract(file, 'clusters_SLR-(\\d+)-(\\w+)_(\\w+)', 3) AS r FROM b)
SELECT file, n_tiles, k, z, x, y, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, CASE s WHEN '' THEN 'unknown' ELSE lower(s) END AS scenario, CASE r WHEN '' THEN 'unknown' ELSE lower(r) END AS risk_type FROM m""")
def tile_coverage(spark, d):
    """Q-C12: coverage features of tile files, their outlines read back from the JSON; some files have no tiles, some bad bounds."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    name = F.concat(F.when(k % 4 == 3, "layer_").otherwise(F.concat(F.lit("clusters_SLR-"), k % 4, F.lit("-Severe_"))), "n_name")
    given = F.when(k % 3 == 1, "none,1,2,3").when(k % 3 == 2, F.concat(k - 20, F.lit(", "), k, F.lit(","), k + 5, F.lit(","), k + 9))
    files = n.select(k.alias("key"), name.alias("file"), given.alias("bounds"))
    tiles = _tiles(spark, d).join(F.broadcast(files.select("key", "file")), F.col("data") % 20 == F.col("key")).select("file", "z", "x", "y")  # nations are 25
    out = catalog.tile_coverage(tiles, files.select("file", "bounds"))
    ring = F.from_json("feature", "geometry struct<coordinates: array<array<array<double>>>>")["geometry"]["coordinates"][0]
    sides = {"west": ring[0][0], "south": ring[2][1], "east": ring[1][0], "north": ring[0][1]}
    return out.select("file", "n_tiles", "k", "z", "x", "y", *(F.round(v, 6).alias(c) for c, v in sides.items()), "scenario", "risk_type")


#: Stems and extensions that the parts' keys are combined to file names of.
STEMS = (
    "clusters_SLR-0-Current_GDP", "1718000000_clusters_SLR-3-Severe_FREIGHT", "clusters_SLR-10-Very Severe_GDP", "1718000000_risk_SLR-1-Conservative_GDP", "exposition_population", "hazard_flood-map",
    "relevance_hrst", "risk_SLR-3-Severe_COMBINED", "SLR 10 freight gdp", "nuts_l3-boundary", "old_port_areas", "my_risk_map", "export_nuts", "notes",
)
EXTENSIONS = ("tif", "cog", "mbtiles", "geojson", "txt")


def _files(spark, d):
    """One file name for each part: a stem, the part's size where it is even, an extension."""
    k, of = F.col("p_partkey"), lambda xs: F.array(*map(F.lit, xs))
    size = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("")
    return table(spark, d, "part").select(F.concat(F.element_at(of(STEMS), (k % len(STEMS) + 1).cast("int")), size, F.lit("."), F.element_at(of(EXTENSIONS), (k % 5 + 1).cast("int"))).alias("key")).distinct()


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_FILES = f"""files AS (SELECT DISTINCT ({_list(STEMS)})[p_partkey % {len(STEMS)} + 1] || CASE WHEN p_size % 2 = 0 THEN '_' || p_size ELSE '' END || '.' || ({_list(EXTENSIONS)})[p_partkey % 5 + 1] AS key FROM part),
named AS (SELECT key, lower(key) AS low, regexp_replace(regexp_replace(key, '\\.[^.]*$', ''), '^\\d+_', '') AS stem FROM files)"""
_ID = r"CASE WHEN regexp_matches(key, 'clusters_SLR-(\d+)-(\w+)_(\w+)') THEN 'clusters-slr-' || lower(regexp_extract(key, 'clusters_SLR-(\d+)-(\w+)_(\w+)', 2)) || '-' || lower(regexp_extract(key, 'clusters_SLR-(\d+)-(\w+)_(\w+)', 3)) ELSE stem END"


@query(f"WITH {_FILES} SELECT key, {_ID} AS layer_id, regexp_extract(key, '(SLR-\\d+-[^_.]+)', 1) AS scenario, regexp_extract(key, 'SLR-\\d+-[^_.]+_([^.]+)', 1) AS rest FROM named")
def layer_id_parse(spark, d):
    """F5, F6, Q7."""
    key = F.col("key")
    return _files(spark, d).select("key", catalog.layer_id(key).alias("layer_id"), catalog.scenario_of(key).alias("scenario"), catalog.rest_of(key).alias("rest"))


_TYPE = """CASE WHEN contains(low, 'cluster') THEN 'clusters' WHEN starts_with(low, 'risk_') OR contains(low, '_risk_') THEN 'risk' WHEN starts_with(low, 'hazard_') OR contains(low, '_hazard_') THEN 'hazard'
WHEN starts_with(low, 'exposition_') OR contains(low, '_exposition_') THEN 'exposition' WHEN starts_with(low, 'relevance_') OR contains(low, '_relevance_') THEN 'relevance' WHEN contains(low, 'slr') THEN 'sea-level-rise'
WHEN starts_with(low, 'nuts') OR contains(low, '_nuts') THEN 'nuts' WHEN starts_with(low, 'port') OR contains(low, '_port_') THEN 'port' ELSE 'unknown' END"""
_NAME = r"""array_to_string(list_transform(string_split(regexp_replace(layer_id, '[_-]', ' ', 'g'), ' '), lambda x: CASE upper(x[1:1]) || x[2:] WHEN 'Slr' THEN 'SLR' WHEN 'Gdp' THEN 'GDP' WHEN 'Hrst' THEN 'HRST' ELSE upper(x[1:1]) || x[2:] END), ' ')"""
_LAYERS = f"""{_FILES}, fit AS (SELECT *, {_ID} AS layer_id FROM named WHERE regexp_matches(key, '\\.(cog|tif|mbtiles)$')), f AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY layer_id ORDER BY key) = 1),
t AS (SELECT key, layer_id, {_TYPE} AS layer_type, {_NAME} AS name, low FROM f), u AS (SELECT *, CASE WHEN NOT ends_with(key, '.mbtiles') THEN 'raster' WHEN starts_with(key, 'clusters_') OR contains(key, 'clusters_SLR') THEN 'vector'
WHEN starts_with(key, 'risk_') OR starts_with(key, 'hazard_') OR starts_with(key, 'exposition_') OR starts_with(key, 'relevance_') THEN 'raster' WHEN layer_type IN ('clusters', 'nuts', 'port') THEN 'vector' ELSE 'raster' END AS data_type FROM t)"""


@query(f"""WITH {_LAYERS} SELECT key, layer_id, layer_type, name, data_type, CASE WHEN ends_with(key, '.mbtiles') THEN 'mbtiles' ELSE 'cog' END AS format,
CASE WHEN layer_id = 'risk_SLR-1-Conservative_GDP' THEN 7 WHEN contains(lower(name), 'nuts') OR contains(lower(name), 'administrative') OR contains(lower(name), 'boundary') THEN 10
WHEN contains(lower(name), 'exposition') OR contains(lower(name), 'exposure') THEN 20 WHEN contains(lower(name), 'relevance') THEN 30 WHEN contains(lower(name), 'hazard') THEN 40 WHEN contains(lower(name), 'risk') THEN 50
WHEN contains(lower(name), 'cluster') THEN 60 WHEN data_type = 'vector' THEN 45 ELSE 25 END AS z FROM u""")
def layer_catalog(spark, d):
    """Q-C8, J16, J18, F7, F8, F9, F11."""
    styles = spark.createDataFrame([("risk_SLR-1-Conservative_GDP", 7)], "layer_id string, z int")
    return catalog.catalogue(_files(spark, d), styles).drop("colours", "bounds", "value_range")


@query(f"""WITH {_LAYERS}, v(kind, colours, bounds, low_value, high_value) AS (VALUES ('risk', '#ffffff #ffff00 #ffa500 #ff0000', '3.5 51.2 7.2 53.5', 0, 1), ('hazard', '#add8e6 #00bfff #0000ff #00008b', '3.5 51.2 7.2 53.5', 0, 1),
('exposition', '#ffffff #90ee90 #228b22 #006400', '3.5 51.2 7.2 53.5', 0, 100), ('relevance', '#ffffff #ffd700 #ff8c00 #ff4500', '3.5 51.2 7.2 53.5', 0, 100), ('clusters', '#ffffff #4fc3f7 #2196f3 #0d47a1', '3.5 51.2 7.2 53.5', 0, 500),
('sea-level-rise', '#ffffff #81c784 #4caf50 #1b5e20', '3.5 51.2 7.2 53.5', 0, 3), ('nuts', '#ffffff #4fc3f7 #2196f3 #0d47a1', '3.5 51.2 7.2 53.5', 0, 500), ('port', '#ffffff #ff6b6b #e53935 #b71c1c', '3.5 51.2 7.2 53.5', 0, 500),
('unknown', '#ffffff #ff6b6b #e53935 #b71c1c', '-180.0 -90.0 180.0 90.0', 0, 100)) SELECT layer_id, colours, bounds, low_value, high_value FROM u JOIN v ON layer_type = kind""")
def layer_defaults(spark, d):
    """F10."""
    found = catalog.catalogue(_files(spark, d), spark.createDataFrame([], "layer_id string, z int"))
    return found.select("layer_id", F.array_join("colours", " ").alias("colours"), F.array_join("bounds", " ").alias("bounds"), F.col("value_range")[0].alias("low_value"), F.col("value_range")[1].alias("high_value"))


@query(f"""WITH {_FILES}, g AS (SELECT key, CASE WHEN contains(low, 'freight') THEN 'Freight' WHEN contains(low, 'gdp') THEN 'GDP' WHEN contains(low, 'hrst') THEN 'HRST' WHEN contains(low, 'population') THEN 'Population' WHEN contains(low, 'combined') THEN 'Combined' ELSE 'Other Layers' END AS indicator,
CASE WHEN regexp_matches(low, 'slr[- ]?\\d') THEN 'SLR ' || regexp_extract(low, 'slr[- ]?(\\d+)', 1) ELSE 'No SLR' END AS r FROM named), h AS (SELECT key, indicator, CASE WHEN indicator = 'Other Layers' THEN '' ELSE r END AS rise FROM g)
SELECT indicator, rise, string_agg(key, ';' ORDER BY key) AS layers, CAST(CASE indicator WHEN 'Combined' THEN 0 WHEN 'Freight' THEN 1 WHEN 'Population' THEN 2 WHEN 'HRST' THEN 3 WHEN 'GDP' THEN 4 ELSE 5 END AS INTEGER) AS indicator_rank,
CAST(coalesce(TRY_CAST(regexp_extract(rise, '(\\d+)', 1) AS INTEGER), -1) AS INTEGER) AS rise_rank FROM h GROUP BY 1, 2""")
def layer_grouping(spark, d):
    """A31, F36, F37."""
    return catalog.grouped(_files(spark, d), "key").withColumn("layers", F.array_join("layers", ";"))


def _blocks(spark, d):
    kinds = F.array(*map(F.lit, content.BLOCK_TYPES))
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("block_id"),
        F.floor(F.col("conv_id") / 2).alias("story_id"),
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("de").alias("language"),
        F.col("turn").alias("order_index"),
        F.element_at(kinds, (F.col("turn") % 8 + 1).cast("int")).alias("block_type"),
        "role",
    ).dropDuplicates(["block_id"])


_KINDS = _list(content.BLOCK_TYPES)
_BLOCKS = f"blocks AS (SELECT DISTINCT conv_id * 1000 + turn AS block_id, conv_id // 2 AS story_id, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'de' END AS language, turn AS order_index, ({_KINDS})[turn % 8 + 1] AS block_type FROM conversations)"


@query(f"""WITH {_BLOCKS}, links AS (SELECT DISTINCT block_id, k AS position, (block_id * 7 + 11 * k) % 40 AS reference_id FROM blocks, range(0, 3) t(k))
SELECT block_id, story_id, coalesce((SELECT string_agg(CAST(reference_id AS VARCHAR), ',' ORDER BY position) FROM links JOIN benchmark ON item_id = reference_id WHERE links.block_id = blocks.block_id), '') AS refs FROM blocks""")
def story_blocks_nested(spark, d):
    """J13, J15, O1, Q-C1: the nested list, in the order of the links, is flattened at the end for comparison."""
    b = _blocks(spark, d).select("block_id", "story_id")
    links = b.select("block_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.col("block_id") * 7 + 11 * k) % 40)).alias("position", "reference_id"))
    refs = table(spark, d, "benchmark").select(F.col("item_id").alias("reference_id"), F.substring("text", 1, 20).alias("title"))
    return content.nested_blocks(b, links, refs).select("block_id", "story_id", F.array_join(F.transform("references", lambda x: x["reference_id"].cast("string")), ",").alias("refs"))


@query(f"""WITH {_BLOCKS}, f AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY story_id, language, order_index ORDER BY block_id) = 1), e AS (SELECT * FROM f WHERE language = 'en'), g AS (SELECT * FROM f WHERE language = 'de')
SELECT coalesce(e.story_id, g.story_id) AS story_id, coalesce(e.order_index, g.order_index) AS order_index, coalesce(e.block_id, -1) AS block_en, coalesce(g.block_id, -1) AS block_de, coalesce(e.block_type, g.block_type) AS block_type FROM e FULL JOIN g ON e.story_id = g.story_id AND e.order_index = g.order_index""")
def block_pairing(spark, d):
    """J14, P22."""
    return content.paired(_blocks(spark, d), "story_id", "en", "de").na.fill(-1)


@query(r"""WITH b AS (SELECT doc_id % 20 AS story, doc_id, 'x \cite{r' || (doc_id * 7 % 11) || '} y \cite{r' || (doc_id * 3 % 5) || '} z' AS c FROM documents),
c AS (SELECT story, 'r' || (doc_id * 7 % 11) AS ref, doc_id * 2 AS pos FROM b UNION ALL SELECT story, 'r' || (doc_id * 3 % 5), doc_id * 2 + 1 FROM b), f AS (SELECT story, ref, min(pos) AS pos FROM c GROUP BY 1, 2)
SELECT story, ref, CAST(row_number() OVER (PARTITION BY story ORDER BY pos) AS INTEGER) AS number FROM f""")
def citation_numbers(spark, d):
    """W5, F15, Q-C14."""
    text = F.concat(F.lit("x \\cite{r"), F.col("doc_id") * 7 % 11, F.lit("} y \\cite{r"), F.col("doc_id") * 3 % 5, F.lit("} z"))
    return content.citation_numbers(table(spark, d, "documents").select((F.col("doc_id") % 20).alias("story"), "doc_id", text.alias("c")), "story", "doc_id", "c")


@query("""WITH a AS (SELECT s_suppkey AS id, (['Jane Smith', 'Smith, J.', 'IPCC', 'Müller', 'van der Berg'])[s_suppkey % 5 + 1] AS author FROM supplier),
b AS (SELECT id, CASE WHEN regexp_extract(author, '([A-Za-z]+)( |$)', 1) <> '' THEN regexp_extract(author, '([A-Za-z]+)( |$)', 1) ELSE regexp_replace(author, '\\s', '', 'g') END || '2020' AS first,
CASE WHEN regexp_extract(author, ' ([A-Za-z]+)$', 1) <> '' THEN regexp_extract(author, ' ([A-Za-z]+)$', 1) ELSE regexp_replace(author, '[^A-Za-z]', '', 'g') END || '2020' AS last FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY last ORDER BY id) AS n FROM b) SELECT id, first, CASE WHEN n = 1 THEN last ELSE last || '-' || n END AS readable_id FROM n""")
def readable_ids(spark, d):
    """Both rules for the base, numbers by the second."""
    names = F.array(*map(F.lit, ("Jane Smith", "Smith, J.", "IPCC", "Müller", "van der Berg")))
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("author"))
    b = a.select("id", content.base_id_first(F.col("author"), F.lit(2020)).alias("first"), content.base_id_last(F.col("author"), F.lit(2020)).alias("last"))
    return content.unique_ids(b, "last", ["id"]).select("id", "first", "readable_id")


@query(f"WITH {_BLOCKS} SELECT block_id, CASE WHEN order_index >= 2 THEN order_index + 1 ELSE order_index END AS order_index FROM blocks")
def order_shift(spark, d):
    """W7, P23."""
    return content.shifted(_blocks(spark, d).select("block_id", "order_index"), "order_index", 2)


@query(f"WITH {_BLOCKS} SELECT block_id, CASE WHEN order_index = 1 THEN 2 WHEN order_index = 2 THEN 1 ELSE order_index END AS order_index FROM blocks")
def order_swap(spark, d):
    """W8."""
    return content.swapped(_blocks(spark, d).select("block_id", "order_index"), "order_index", 1, 2)


@query(f"WITH {_BLOCKS} SELECT story_id, max(order_index) + 1 AS next_index FROM blocks GROUP BY 1")
def next_position(spark, d):
    """A22, Q-C7."""
    return content.next_position(_blocks(spark, d), "story_id", "order_index")


@query("SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_name DESC) * 10 AS INTEGER) AS z_index FROM nation")
def zindex_renumber(spark, d):
    """W9."""
    return catalog.renumbered(table(spark, d, "nation").select("n_nationkey", "n_name"), [F.col("n_name").desc()])


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'x') OR contains(lower(p_type), 'o')) AND p_brand = 'Brand#13'")
def gallery_search(spark, d):
    """P25, P26, P31, Q-C13."""
    return content.search(table(spark, d, "part").withColumn("tags", F.array("p_brand", "p_type")), "O", [], ["tags"], p_brand="Brand#13", p_type="all").union(
        content.search(table(spark, d, "part").withColumn("tags", F.array("p_brand", "p_type")), "X", ["p_name"], [], p_brand="Brand#13").where(~F.contains(F.lower("p_type"), F.lit("o")))
    ).select("p_partkey", "p_name")


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1")
def gallery_facets(spark, d):
    """A26."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("n_types"))


#: Payloads of made-up blocks; the problems that each gives a type stand, typed by hand, in the SQL beside.
PAYLOADS = (
    '{"variant":"info","text":"q","author":" ","stats":[{"label":"a","value":"","color":"#12345g"},{"label":"","value":"1","color":"#abc"}],"events":[{"year":1700,"title":""},{"year":2000,"title":"t","color":"red"}],'
    '"metrics":[{"title":"","value":"v","progress":101}],"startYear":1800,"endYear":1700,"rotations":30,"type":"map","imageCategory":"x","imageScenario":"current","imageIndicators":["gdp","oil"]}',
    "{}",
    "no json",
    None,
    '{"variant":"error","text":"q","author":"a","stats":[{"label":"a","value":"1"}],"events":[{"year":1850,"title":"t","color":"#AbCdEf"}],"metrics":[{"title":"t","value":"v","progress":0}],"startYear":1850,"endYear":2100,"rotations":20,'
    '"type":"gauge","imageCategory":"risk-clusters","imageScenario":"none","imageIndicators":[]}',
)
_EMPTY = ", ".join(
    f"('{kind}', {i}, '{found}')"
    for kind, found in (
        ("callout", "data.variant:unknown"), ("interactive-callout", "data.variant:unknown"), ("animated-quote", "data.text:required;data.author:required"), ("animated-statistics", "data.stats:required"), ("climate-timeline", "data.events:required"),
        ("climate-timeline-minimal", "data.events:required"), ("climate-dashboard", "data.metrics:required"), ("visualization", "data.type:unknown"),
    )
    for i in (1, 2, 3)
)


@query(f"""WITH k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 16 = 14 THEN 'podcast' WHEN p_partkey % 16 = 15 THEN NULL ELSE ({_list(content.BLOCK_TYPES)})[p_partkey % 16 + 1] END AS kind, p_partkey % 5 AS payload, p_partkey % 3 AS lang,
p_partkey % 4 - 1 AS pos, p_partkey % 7 AS story, p_size, p_partkey % 11 AS c FROM part),
v(kind, payload, found) AS (VALUES {_EMPTY}, ('animated-quote', 0, 'data.author:required'), ('animated-statistics', 0, 'data.stats.0.value:required;data.stats.0.color:not a colour;data.stats.1.label:required'),
('climate-timeline', 0, 'data.events.0.year:out of range;data.events.0.title:required;data.events.1.color:not a colour'), ('climate-timeline-minimal', 0, 'data.events.0.year:out of range;data.events.0.title:required'),
('climate-dashboard', 0, 'data.metrics.0.title:required;data.metrics.0.progress:out of range'), ('temperature-spiral', 0, 'data.startYear:out of range;data.endYear:out of range;data.endYear:not after start;data.rotations:out of range'),
('visualization', 0, 'data.imageCategory:unknown;data.imageIndicators:unknown'))
SELECT id, concat_ws(';', CASE WHEN k.kind IS NULL THEN 'block_type:required' END, CASE WHEN lang = 2 THEN 'language:required' END, CASE WHEN pos = 0 THEN 'order_index:required' END, CASE WHEN story = 0 THEN 'story_id:too short' END,
CASE WHEN k.kind = 'podcast' THEN 'block_type:unknown' END, CASE WHEN pos < 0 THEN 'order_index:negative' END, CASE WHEN k.payload = 2 THEN 'data:not JSON' END, CASE WHEN p_size > 40 THEN 'title:too long' END,
CASE WHEN c = 1 THEN 'content:too long' END, found, CASE WHEN k.kind = 'markdown' AND c = 0 THEN 'content:required' END) AS problems FROM k LEFT JOIN v ON k.kind = v.kind AND k.payload = v.payload""")
def content_validation(spark, d):
    """Blocks made from the parts' keys."""
    k = F.col("p_partkey")
    kinds, payloads = F.array(*map(F.lit, [*content.BLOCK_TYPES, "podcast", None])), F.array(*map(F.lit, PAYLOADS))
    text = F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, F.repeat(F.lit("x"), F.lit(5001))).otherwise("text")
    found = content.problems(
        F.element_at(kinds, (k % 16 + 1).cast("int")), F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit(None)), (k % 3 + 1).cast("int")), k % 4 - 1,
        F.when(F.col("p_size") > 40, F.repeat(F.lit("t"), F.lit(201))).otherwise("title"), text, F.element_at(payloads, (k % 5 + 1).cast("int")), F.when(k % 7 == 0, " ab ").otherwise("story"),
    )
    return table(spark, d, "part").select(k.alias("id"), F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["field"], x["rule"])), ";").alias("problems"))


@query("SELECT count(*) AS n, count(nullif(o_orderpriority, '5-LOW')) AS with_value, count(*) - count(nullif(o_orderpriority, '5-LOW')) AS missing FROM orders")
def completeness(spark, d):
    """A23."""
    v = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("with_value"), (F.count(F.lit(1)) - F.count(v)).alias("missing"))


@query("SELECT o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_ok, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS rate FROM orders GROUP BY 1")
def conversion_summary(spark, d):
    """A27, K8."""
    out = tabular.coverage(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")
    return out.select(F.col("o_orderpriority").alias("kind"), "n", "n_ok", F.round("rate", 6).alias("rate"))


@query("""SELECT n_nationkey, '{"type":"Feature","properties":{"n_name":"' || n_name || '"},"geometry":{"type":"Point","coordinates":[' || n_nationkey || ',' || n_regionkey || ']}}' AS feature FROM nation""")
def geojson_features(spark, d):
    """S15, G19, K10."""
    n = table(spark, d, "nation").withColumn("g", F.concat(F.lit('{"type":"Point","coordinates":['), "n_nationkey", F.lit(","), "n_regionkey", F.lit("]}")))
    return n.select("n_nationkey", feature("g", ["n_name"]).alias("feature"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Extension: tumbling windows; the same function runs on a stream with a watermark."""
    return events.hourly(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark, d):
    """Extension: sessions with a gap of 30 minutes."""
    return events.sessions(table(spark, d, "events"))
