import pytest
from pyspark.sql import functions as F

from cellward.functions import risk
from cellward.operators import catalog, content, normalise
from cellward.plans.config import CLASS_WEIGHTS, EXPOSITION_WEIGHTS, GridSpec, Settings

DEM = [-5.0, 0.0, 1.0, 5.0, 14.0, 24.0, 26.0, 40.0]
CURVES = {
    (0.0, 1.4): [0.974404, 0.8, 0.293725, 0.016869, 0.140484, 0.062246, 0.009144, 0.003008],
    (3.0, 1.4): [0.986520, 0.947605, 0.920103, 0.143791, 0.000232, 0.072313, 0.009144, 0.003008],
    (15.0, 1.4): [0.989991, 0.989895, 0.989827, 0.988720, 0.874759, 0.000969, 0.009144, 0.003008],
    (0.0, 6.0): [0.974404, 0.8, 0.507889, 0.260759, 0.140484, 0.062246, 0.009144, 0.003008],
}


@pytest.mark.parametrize("key", CURVES)
def test_elevation_curve(spark, key):
    rise, decay = key
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(DEM)], "i int, dem double").select("i", risk.elevation_risk(F.col("dem"), F.lit(rise), F.lit(13.5), decay).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == pytest.approx(CURVES[key], abs=1e-6)


CASES = [
    ("hazard", [0, 0.2, 0.5, 0.7, 0], "i < 4", [0.05, 0.2, 0.5, 0.7, 0]),
    ("exposition", [0, 0.2, 0.5, 0.7, 0], "true", [0.01, 0.285714, 0.714286, 1, 0.01]),
    ("economic", [0, 0.2, 0.5, 0.7, 0], "v > 0", [0, 0.257143, 0.642857, 0.9, 0]),
    ("full_range", [0, 0.2, 0.5, 0.7, 0], "v > 0", [0, 0.285714, 0.714286, 1, 0]),
    ("hazard", [1, 2, 3, 10], "true", [0.097038, 0.194076, 0.291113, 0.954020]),
    ("economic", [1, 2, 3, 10], "true", [0.102145, 0.204290, 0.306435, 1.004225]),
]


@pytest.mark.parametrize("kind, values, mask, want", CASES)
def test_normalisers(spark, kind, values, mask, want):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = normalise.normalise(df, "v", kind, F.expr(mask)).orderBy("i").collect()
    assert [r.normalised for r in got] == pytest.approx(want, abs=1e-6)


def test_unknown_normaliser(spark):
    with pytest.raises(ValueError):
        normalise.normalise(spark.range(1), "id", "other", F.lit(True))


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    ids = {
        "clusters_SLR-0-Current_GDP.mbtiles": "clusters-slr-current-gdp",
        "1718000000_clusters_SLR-3-Severe_FREIGHT.mbtiles": "clusters-slr-severe-freight",
        "clusters_SLR-10-Very Severe_GDP.mbtiles": "clusters_SLR-10-Very Severe_GDP",
        "1718000000_risk_SLR-1-Conservative_GDP.tif": "risk_SLR-1-Conservative_GDP",
    }
    for name, want in ids.items():
        assert one(catalog.layer_id(F.lit(name))) == want
    for name, first, last in (("Jane Smith", "Jane2020", "Smith2020"), ("Smith, J.", "Smith,J.2020", "SmithJ2020"), ("IPCC", "IPCC2020", "IPCC2020"), ("Müller", "ller2020", "Mller2020"), ("van der Berg", "van2020", "Berg2020")):
        assert one(content.base_id_first(F.lit(name), F.lit(2020))) == first
        assert one(content.base_id_last(F.lit(name), F.lit(2020))) == last


def test_multipliers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    for urban, semi, want in ((0.9, 0.1, 1.15), (0.5, 0.3, 1.05), (0.1, 0.2, 0.5)):
        assert one(risk.urban_multiplier(F.lit(urban), F.lit(semi))) == want
    assert one(risk.integrated_risk(F.lit(0.5), F.lit(0.4), F.lit(True))) == pytest.approx(0.41)
    for cls, want in ((1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.5), (11, 0.05), (12, 0.1), (13, 0.1), (14, 0.15), (15, 0.15), (21, 0.25), (22, 0.7), (23, 0.7), (24, 0.9), (25, 1.0), (7, 0.0)):
        assert one(risk.class_weight(F.lit(cls), CLASS_WEIGHTS)) == want


def test_settings_and_grid():
    Settings().check()
    with pytest.raises(ValueError):
        Settings(risk_weights={"hazard": 0.2, "economic": 0.9}).check()
    assert GridSpec.covering(0, 0, 100, 61, 30) == GridSpec(0, 61, 30, 4, 3)


def test_exposition_weights():
    assert EXPOSITION_WEIGHTS["exposition"] == {"class": 0.30, "volume": 0.30, "population": 0.13, "power": 0.12, "census": 0.15}
    assert EXPOSITION_WEIGHTS["gdp"] == {"class": 0.25, "volume": 0.34, "population": 0.13, "power": 0.18, "census": 0.10}
    assert EXPOSITION_WEIGHTS["freight"] == {"class": 0.32, "volume": 0.34, "population": 0.06, "power": 0.18, "census": 0.10}
    assert EXPOSITION_WEIGHTS["hrst"] == {"class": 0.27, "volume": 0.36, "population": 0.09, "power": 0.18, "census": 0.10}
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in EXPOSITION_WEIGHTS.values())


LAYERS = [
    # file name, type, data type, format, place in the stack
    ("clusters_SLR-0-Current_GDP.mbtiles", "clusters", "vector", "mbtiles", 60),
    ("1718_clusters_SLR-1-Severe_HRST.mbtiles", "clusters", "vector", "mbtiles", 60),
    ("my_cluster.mbtiles", "clusters", "vector", "mbtiles", 60),
    ("risk_SLR-1-x_GDP.mbtiles", "risk", "raster", "mbtiles", 50),
    ("old_risk_map.cog", "risk", "raster", "cog", 50),
    ("hazard_x.tif", "hazard", "raster", "cog", 40),
    ("exposition_x.tif", "exposition", "raster", "cog", 20),
    ("relevance_x.tif", "relevance", "raster", "cog", 30),
    ("SLR-3.mbtiles", "sea-level-rise", "raster", "mbtiles", 25),
    ("nuts_l3.mbtiles", "nuts", "vector", "mbtiles", 10),
    ("nuts_cluster.tif", "clusters", "raster", "cog", 10),
    ("port_a.mbtiles", "port", "vector", "mbtiles", 45),
    ("flood.tif", "unknown", "raster", "cog", 25),
    ("flood.geojson", "unknown", None, None, 25),
]


def test_layers(spark):
    key = F.col("key")
    rows = spark.createDataFrame([(x[0],) for x in LAYERS], "key string")
    got = rows.select("key", catalog.layer_type(key), catalog.data_type(key), catalog.file_format(key), catalog.z_index(catalog.display_name(catalog.layer_id(key)), catalog.data_type(key))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(LAYERS, key=repr)


def test_shown_names_and_indicators(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    for name, want in (("clusters-slr-current-gdp", "Clusters SLR Current GDP"), ("risk_SLR-3-Very Severe_hrst", "Risk SLR 3 Very Severe HRST"), ("a_b-c", "A B C"), ("gdpx", "Gdpx"), ("slr.gdp_", "SLR.GDP")):
        assert one(catalog.display_name(F.lit(name))) == want
    for name, want in (("gdp_FREIGHT", "Freight"), ("GDP hrst", "GDP"), ("hrst population", "HRST"), ("population combined", "Population"), ("combined", "Combined"), ("x", "Other Layers")):
        assert one(catalog.indicator(F.lit(name))) == want


def test_content_types(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    cases = (("89504E470D0A1A0A", None, "image/png"), ("FFD8000000000000", None, "image/jpeg"), ("FFD800", None, "application/x-protobuf"), ("524946460000000057454250", None, "image/webp"), ("524946460000000000000000", None, "application/x-protobuf"), ("1F8B080000000000", None, "application/x-protobuf"), ("89504E470D0A1A0A", "PBF", "application/x-protobuf"), ("00", "jpg", "image/jpeg"), ("FFD8000000000000", "tiff", "image/jpeg"))
    for head, form, want in cases:
        assert one(catalog.content_type(F.unhex(F.lit(head)), F.lit(form).cast("string"))) == want, (head, form)


def test_cited_texts_and_positions(spark):
    rows = spark.createDataFrame([(r"a \cite{y} b \cite{q}\cite{x}.", ["x", "y"])], "c string, refs array<string>")
    assert rows.select(content.numbered_text(F.col("c"), F.col("refs")).alias("v")).first().v == r"a [2] b \cite{q}[1]."
    numbers = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "c", 1)], "document int, ref string, number int")
    references = spark.createDataFrame([(d, r, i) for d in (1, 2) for i, r in enumerate("abc")], "document int, id string, at int")
    got = content.cited_first(references, numbers, "document", "id", "at").collect()
    assert {d: "".join(r.id for r in sorted((r for r in got if r.document == d), key=lambda r: r["rank"])) for d in (1, 2)} == {1: "bac", 2: "cab"}


def test_new_blocks(spark):
    stories = spark.createDataFrame([(1,), (2,)], "story_id int")
    blocks = spark.createDataFrame([(1, 4), (1, 2)], "story_id int, order_index int")
    payloads = spark.createDataFrame([(i, '{"type":"callout","title":"T"}', '{"title":""}') for i in (1, 2, 3)], "story_id int, en string, de string")
    got = sorted(tuple(r) for r in content.paired_insert(stories, blocks, payloads).select("story_id", "language", "order_index", "block_type", F.coalesce("title", F.lit("-"))).collect())
    assert got == [(1, "de", 5, "markdown", "-"), (1, "en", 5, "callout", "T"), (2, "de", 1, "markdown", "-"), (2, "en", 1, "callout", "T")]
    assert spark.range(1).select(content.default_payload(F.lit("temperature-spiral")).alias("v")).first().v == '{"startYear":1880,"endYear":2030,"rotations":8}'
    assert spark.range(1).select(content.default_payload(F.lit("other")).alias("v")).first().v == "{}"
