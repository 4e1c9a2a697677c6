"""Queries of the map and story pages over the star tables, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellward.operators import content, render, web
from cellward.sources.storage import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query and the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("SELECT p_partkey, p_partkey % 4 = 1 OR p_partkey % 6 = 0 OR p_partkey = 7 AS visible FROM part")
def layer_visibility(spark, d):
    """P27."""
    keys = table(spark, d, "part").select(F.col("p_partkey").alias("layer_id"))
    lists = keys.groupBy((F.col("layer_id") % 4).cast("string").alias("group_id")).agg(F.collect_list("layer_id").alias("layer_ids"))
    sixth = keys.where("layer_id % 6 = 0").agg(F.collect_list("layer_id").alias("layers"))
    one = lists.crossJoin(F.broadcast(sixth)).select("group_id", "layer_ids", F.create_map(F.lit("gdp"), F.struct("layers", F.lit(7).cast("bigint").alias("cluster_layer"))).alias("indicators"))
    return web.visible(keys, one, "1", "gdp").select(F.col("layer_id").alias("p_partkey"), "visible")


@query("SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END AS indicator FROM part")
def indicator_keys(spark, d):
    """A33."""
    groups = table(spark, d, "part").select(F.create_map(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("none"), F.lit(1)).alias("m"))
    return web.indicator_keys(groups, "m")


@query("""SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'O') AS success, count(*) FILTER (o_orderstatus = 'F') AS warning, count(*) FILTER (o_orderstatus = 'P') AS danger FROM orders GROUP BY 1""")
def status_counts(spark, d):
    """A24."""
    status = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "warning").when(F.col("o_orderstatus") == "P", "danger")
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(status.alias("status"))).alias("m"))
    s, w, x = web.status_counts(F.col("m"))
    return own.select("id", s.cast("bigint").alias("success"), w.cast("bigint").alias("warning"), x.cast("bigint").alias("danger"))


@query("SELECT s_suppkey, concat_ws(';', CASE WHEN s_suppkey % 3 > 0 THEN 'name=' || s_name END, 'nation=' || s_nationkey) AS shown FROM supplier")
def popup_attributes(spark, d):
    """P28."""
    m = F.create_map(F.lit("id"), F.col("s_suppkey").cast("string"), F.lit("name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).otherwise(""), F.lit("nation"), F.col("s_nationkey").cast("string"))
    shown = F.array_join(F.transform(F.map_entries(web.without(m, ("id",))), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return table(spark, d, "supplier").select("s_suppkey", shown.alias("shown"))


@query("""WITH t AS (SELECT DISTINCT CAST(6 + event_id % 7 AS INTEGER) AS z, event_id * 7919 % 64 AS x, event_id * 104729 % 64 AS y FROM events), b AS (SELECT *, x / power(2.0::DOUBLE, z) * 360 - 180 AS west, (x + 1) / power(2.0::DOUBLE, z) * 360 - 180 AS east,
degrees(atan(sinh(pi() * (1 - 2 * y / power(2.0::DOUBLE, z))))) AS north, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / power(2.0::DOUBLE, z))))) AS south FROM t) SELECT z, x, y FROM b WHERE z BETWEEN 7 AND 10 AND NOT (east < -60 OR west > 70 OR north < 20 OR south > 80)""")
def tile_gate(spark, d):
    """P29."""
    t = table(spark, d, "events").select((6 + F.col("event_id") % 7).cast("int").alias("z"), (F.col("event_id") * 7919 % 64).alias("x"), (F.col("event_id") * 104729 % 64).alias("y")).distinct()
    return web.tiles_inside(t, F.lit(7), F.lit(10), F.array(*map(F.lit, (-60.0, 20.0, 70.0, 80.0))))


@query("""WITH g AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderkey % 14) AS top, count(DISTINCT o_orderkey % 14) AS k FROM orders GROUP BY 1)
SELECT id, concat_ws(';', CASE WHEN n * 10 < 100 THEN 'few tiles' END, CASE WHEN id % 5 = 0 THEN 'default bounds' END, CASE WHEN id % 3 > 0 AND top < 12 THEN 'low maximum zoom' END, CASE WHEN top < 10 THEN 'no high zoom' END, CASE WHEN k < 6 THEN 'few zooms' END) AS advice FROM g""")
def tile_advice(spark, d):
    """F31, Q-C10: a customer's orders stand for tiles, key modulo 14 for their zoom."""
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.col("o_orderkey") % 14).alias("zooms"))
    bounds, top = F.when(F.col("id") % 5 == 0, "-15,30,35,75").otherwise("3,51,7,53"), F.when(F.col("id") % 3 > 0, F.array_max("zooms").cast("string"))
    return g.select("id", F.array_join(web.advice(F.col("n") * 10, bounds, top, F.col("zooms")), ";").alias("advice"))


@query("""WITH v AS (SELECT o_orderkey, o_totalprice * 10 AS v, CASE o_orderkey % 4 WHEN 0 THEN 't' WHEN 1 THEN 'persons' WHEN 2 THEN '€M' ELSE 'x' END AS unit FROM orders WHERE abs(o_totalprice * 10 % 1000 - 500) > 1 AND abs(o_totalprice * 10 % 1 - 0.5) > 0.01 AND abs(o_totalprice * 10 % 100000 - 50000) > 1)
SELECT o_orderkey, CASE WHEN unit IN ('t', 'persons') THEN CASE WHEN v >= 1000000 THEN format('{:.1f}M ', v / 1000000) || unit WHEN v >= 1000 THEN format('{:.0f}K ', v / 1000) || unit ELSE format('{:,}', CAST(round(v) AS BIGINT)) || ' ' || unit END
WHEN unit = '€M' THEN format('{:,}', CAST(round(v) AS BIGINT)) || ' €M' ELSE format('{:,}', CAST(round(v) AS BIGINT)) END AS shown FROM v""")
def numbers_with_units(spark, d):
    """F17; values next to a rounding tie are left out, as the two engines' last digits differ there."""
    v = F.col("o_totalprice") * 10
    unit = F.element_at(F.array(*map(F.lit, ("t", "persons", "€M", "x"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").where((F.abs(v % 1000 - 500) > 1) & (F.abs(v % 1 - 0.5) > 0.01) & (F.abs(v % 100000 - 50000) > 1))
    return rows.select("o_orderkey", web.with_unit(v, unit).alias("shown"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal <> 0 THEN (c_nationkey * 100 - c_acctbal) * 100.0 / c_acctbal END, 6) AS change FROM customer")
def impact_change(spark, d):
    """F3."""
    return table(spark, d, "customer").select("c_custkey", F.round(web.change_percent(F.col("c_acctbal"), F.col("c_nationkey") * 100), 6).alias("change"))


_KEYS = "k AS (SELECT DISTINCT 'images/' || p_brand || '/' || CASE WHEN p_size % 2 = 0 THEN 'severe' ELSE 'current' END || '/layer.' || p_size || CASE p_partkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.mbtiles' ELSE '.PNG' END AS key FROM part)"


def _keys(spark, d):
    size = F.col("p_size").cast("string")
    ext = F.element_at(F.array(*map(F.lit, (".tif", ".mbtiles", ".PNG"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("images/"), "p_brand", F.when(F.col("p_size") % 2 == 0, "/severe/layer.").otherwise("/current/layer."), size, ext).alias("key")).distinct()


@query(f"WITH {_KEYS} SELECT key, regexp_extract(key, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(key, '([^/]*)\\.[^./]*$', 1) AS stem, lower(regexp_extract(key, '\\.([^./]*)$', 1)) AS ext FROM k")
def path_parts(spark, d):
    """F33."""
    parent, stem, ext = web.parts_of(F.col("key"))
    return _keys(spark, d).select("key", parent.alias("parent"), stem.alias("stem"), ext.alias("ext"))


@query(f"WITH {_KEYS} SELECT key FROM k WHERE regexp_extract(key, '([^/]*)\\.[^./]*$', 1) = 'layer.7' OR regexp_extract(key, '[^/]*$') = 'layer.7'")
def layer_files(spark, d):
    """Q-C15."""
    return web.named(_keys(spark, d), "layer.7")


@query(f"""WITH {_KEYS}, s AS (SELECT 'layer.' || n_nationkey AS stem, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS category, CASE WHEN n_nationkey % 3 = 0 THEN 'all' END AS scenario, n_name AS title FROM nation)
SELECT key, coalesce(s.category, split_part(key, '/', 2)) AS category, coalesce(s.scenario, split_part(key, '/', 3)) AS scenario, s.title FROM k LEFT JOIN s ON s.stem = regexp_extract(key, '([^/]*)\\.[^./]*$', 1)""")
def images_with_side_data(spark, d):
    """S18, J17, K13."""
    k = F.col("n_nationkey")
    side = table(spark, d, "nation").select(F.concat(F.lit("layer."), k.cast("string")).alias("stem"), F.when(k % 2 == 0, F.col("n_name")).alias("category"), F.when(k % 3 == 0, "all").alias("scenario"), F.col("n_name").alias("title"))
    return web.with_side_data(_keys(spark, d), side)


@query(f"WITH {_KEYS} SELECT a.key AS original, b.key AS converted FROM k a JOIN k b ON a.key LIKE '%.tif' AND b.key = regexp_replace(a.key, '\\.tif$', '.mbtiles')")
def converted_files(spark, d):
    """J22."""
    return web.paired_files(_keys(spark, d), "tif", "mbtiles")


@query("""SELECT event_id, w >= -180 AND e <= 180 AND s >= -90 AND n <= 90 AND w <= 180 AND e >= -180 AND s <= 90 AND n >= -90 AND e - w BETWEEN 0.001 AND 350 AND n - s BETWEEN 0.001 AND 170 AS ok
FROM (SELECT event_id, event_id * 37 % 400 - 200 AS w, event_id * 37 % 400 - 200 + event_id % 7 * 60 AS e, event_id * 13 % 200 - 100 AS s, event_id * 13 % 200 - 100 + event_id % 5 * 40 AS n FROM events)""")
def export_gate(spark, d):
    """K5."""
    k = F.col("event_id")
    w, s = k * 37 % 400 - 200, k * 13 % 200 - 100
    return table(spark, d, "events").select("event_id", web.export_ok(w, s, w + k % 7 * 60, s + k % 5 * 40).alias("ok"))


@query("""SELECT event_type AS type, count(*) AS entries, sum(event_id % 5) AS hits, sum(event_id % 3) AS misses, sum(user_id) AS bytes, round(sum(event_id % 5) / (sum(event_id % 5) + sum(event_id % 3)), 6) AS hit_rate FROM events GROUP BY 1""")
def cache_statistics(spark, d):
    """A28."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("type"), (F.col("event_id") % 5).alias("hits"), (F.col("event_id") % 3).alias("misses"), F.col("user_id").alias("size"))
    return web.cache_statistics(rows).withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT o_orderkey FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '7') AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 900 AND o_orderstatus = 'F'")
def cache_invalid(spark, d):
    """Q-C17, F35."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"), F.to_date("o_orderdate").alias("created"), F.col("o_orderstatus").alias("type"))
    return web.invalid(rows, "7", 900, "F", F.to_date(F.lit("1998-08-02"))).select("o_orderkey")


@query("SELECT round(sum(l_quantity), 2) AS total, round((sum(l_quantity) - 150000) * 100.0 / 150000, 6) AS deviation, abs((sum(l_quantity) - 150000) * 100.0 / 150000) <= 5 AS ok FROM lineitem")
def total_check(spark, d):
    """A18."""
    out = web.total_within(table(spark, d, "lineitem"), "l_quantity", 150000.0, 5.0)
    return out.select(F.round("total", 2).alias("total"), F.round("deviation", 6).alias("deviation"), "ok")


@query("SELECT conv_id AS story_id, min(turn) AS first_turn, count(*) AS n_blocks FROM conversations GROUP BY 1")
def story_list(spark, d):
    """Q-C4: stories with their blocks' number; readers order by id."""
    return content.story_list(table(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 2 = 0 AND role IN ('user', 'system')")
def blocks_by_type(spark, d):
    """Q-C3, Q-C5: blocks of some types (roles) in the stories of a language (even ids)."""
    return content.blocks_of(table(spark, d, "conversations"), ["user", "system"], "role", F.col("conv_id") % 2 == 0).select("conv_id", "turn", "role")


@query("SELECT item_id, CASE WHEN item_id % 7 > 0 THEN CAST(2000 + item_id % 25 AS BIGINT) END AS year, CAST(rank() OVER (ORDER BY CASE WHEN item_id % 7 > 0 THEN item_id % 25 END DESC NULLS LAST) AS INTEGER) AS place FROM benchmark")
def references_newest_first(spark, d):
    """Q-C2: place by year; a seventh has none."""
    own = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 7 > 0, 2000 + F.col("item_id") % 25).alias("year"))
    return content.newest_first(own, "year").select("item_id", "year", "place")


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) LIKE 'brand#1%' AND NOT p_name LIKE '%ring'")
def names_by_prefix(spark, d):
    """Brands by a prefix in any case, without the parts that count as totals."""
    return web.by_prefix(table(spark, d, "part"), "p_brand", "BRAND#1", F.col("p_name").endswith("ring")).select("p_partkey", "p_brand")


@query("SELECT event_id, f AS file FROM (SELECT event_id, event_type || CASE event_id % 6 WHEN 0 THEN '_GDP' WHEN 1 THEN '_freight' WHEN 2 THEN '_freight_loading' WHEN 3 THEN '_hrst' WHEN 4 THEN '_population' ELSE '_combined' END AS f FROM events) WHERE regexp_matches(lower(f), '_(gdp|population|freight)') AND NOT regexp_matches(lower(f), 'loading|unloading')")
def output_files(spark, d):
    """Outputs of three indicators, without the parts of freight."""
    part = F.element_at(F.array(*map(F.lit, ("_GDP", "_freight", "_freight_loading", "_hrst", "_population", "_combined"))), (F.col("event_id") % 6 + 1).cast("int"))
    files = table(spark, d, "events").select("event_id", F.concat("event_type", part).alias("file"))
    return web.outputs_of(files, "file", ["gdp", "population", "freight"], ["loading", "unloading"])


@query("""WITH base AS (SELECT conv_id * 1000 + turn AS id, conv_id AS story, turn AS place, role AS body, turn % 3 AS version, false AS deleted FROM conversations WHERE turn % 5 < 4),
log AS (SELECT conv_id * 1000 + turn AS id, conv_id AS story, turn + 10 * (turn % 2) AS place, 'changed ' || role AS body, turn % 4 AS version, turn % 7 = 2 AS deleted FROM conversations WHERE conv_id % 3 < 2),
two AS (SELECT *, 0 AS fresh FROM base UNION ALL SELECT *, 1 FROM log), one AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, fresh) = 1)
SELECT id, story, body, CAST(row_number() OVER (PARTITION BY story ORDER BY place, id) AS INTEGER) AS place FROM one WHERE NOT deleted""")
def merged_blocks(spark, d):
    """Inserts, updates and deletes by version applied twice to a table of blocks, and the gaps closed."""
    own = table(spark, d, "conversations")
    shape = lambda df, place, body, version, gone: df.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("story"), place.alias("place"), body.alias("body"), version.alias("version"), gone.alias("deleted"))
    turn = F.col("turn")
    base = shape(own.where(turn % 5 < 4), turn, F.col("role"), turn % 3, F.lit(False))
    log = shape(own.where("conv_id % 3 < 2"), turn + 10 * (turn % 2), F.concat(F.lit("changed "), F.col("role")), turn % 4, turn % 7 == 2)
    once = content.merged(base, log, ["id"])
    return content.visible(content.merged(once, log, ["id"]), "story", "place", ["id"]).select("id", "story", "body", "place")


_TYPES = ("visualization", "markdown", "callout", "quote", "statistics", "animated-quote", "climate-dashboard", "image")


def _page_blocks(spark, d):
    k = F.col("conv_id") * 31 + F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (k % len(_TYPES) + 1).cast("int"))
    part = lambda n, value: F.when(k % n > 0, value)
    data = F.create_map(F.lit("title"), part(3, F.concat(F.lit("t"), "turn")), F.lit("content"), part(4, F.substring("text", 1, 9)), F.lit("author"), part(5, F.col("role")), F.lit("role"), F.lit(""), F.lit("variant"), part(7, F.lit("warn")))
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("block_type"), F.when(k % 5 < 2, F.col("role")).when(k % 5 == 2, F.lit("")).alias("title"), F.when(k % 6 < 2, F.substring("text", 3, 5)).alias("content"), data.alias("data"))


_PAGE = """b AS (SELECT conv_id, turn, ['visualization', 'markdown', 'callout', 'quote', 'statistics', 'animated-quote', 'climate-dashboard', 'image'][CAST(k % 8 AS INTEGER) + 1] AS t, CASE WHEN k % 5 < 2 THEN role WHEN k % 5 = 2 THEN '' END AS title, CASE WHEN k % 6 < 2 THEN substr(text, 3, 5) END AS content,
 CASE WHEN k % 3 > 0 THEN 't' || turn END AS dt, CASE WHEN k % 4 > 0 THEN substr(text, 1, 9) END AS dc, CASE WHEN k % 5 > 0 THEN role END AS da, CASE WHEN k % 7 > 0 THEN 'warn' END AS dv FROM (SELECT *, conv_id * 31 + turn AS k FROM conversations))"""


@query(f"""WITH {_PAGE} SELECT conv_id, turn, t AS type,
CASE t WHEN 'visualization' THEN title WHEN 'callout' THEN coalesce(nullif(title, ''), dt, '') WHEN 'animated-quote' THEN coalesce(title, '') WHEN 'climate-dashboard' THEN coalesce(nullif(title, ''), dt) WHEN 'image' THEN coalesce(nullif(title, ''), dt) END AS title,
CASE t WHEN 'visualization' THEN content WHEN 'markdown' THEN coalesce(nullif(content, ''), nullif(dc, ''), '') WHEN 'callout' THEN coalesce(nullif(content, ''), nullif(dc, ''), '') WHEN 'quote' THEN dc WHEN 'animated-quote' THEN coalesce(content, '') WHEN 'image' THEN coalesce(nullif(content, ''), nullif(dc, '')) END AS content,
CASE t WHEN 'quote' THEN da WHEN 'animated-quote' THEN coalesce(da, '') END AS author, CASE WHEN t IN ('quote', 'animated-quote') THEN '' END AS role, CASE t WHEN 'callout' THEN coalesce(dv, 'default') END AS variant FROM b""")
def render_model(spark, d):
    """blocks by their type, fields from the block or its data."""
    return render.model(_page_blocks(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "type", "title", "content", "author", "role", "variant")


@query(f"WITH {_PAGE} SELECT conv_id, turn, coalesce(dt, '') AS title, coalesce(dc, '') AS content, 'map' AS type, '' AS \"imageId\" FROM b WHERE t = 'visualization'")
def visualisation_blocks(spark, d):
    """visualisations with their defaults."""
    return render.visualisations(_page_blocks(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "title", "content", "type", "imageId")


@query(r"""SELECT conv_id, turn, substr(text, 1, turn * 7) || '\cite{' || role || turn || '}' || substr(text, turn * 7 + 1) AS text FROM conversations""")
def citations_put_in(spark, d):
    """a citation put into a text at the cursor."""
    return table(spark, d, "conversations").select("conv_id", "turn", render.cited_at(F.col("text"), (F.col("turn") * 7).cast("int"), F.concat("role", "turn")).alias("text"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'image/tiff' WHEN 1 THEN 'application/vnd.mapbox-vector-tile' WHEN 2 THEN 'application/geo+json' ELSE 'application/octet-stream' END AS content_type FROM events""")
def file_content_types(spark, d):
    """content types by ending; one file's ending is unknown, another has none."""
    ending = F.element_at(F.array(*map(F.lit, (".TIF", ".mbtiles", ".GeoJSON", ".zip", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", render.file_content_type(F.concat("event_type", F.lit(".d/x"), ending)).alias("content_type"))
