"""How plans join a layer with its statistics: by broadcast, never by a shuffle or a product of the layer."""

import pytest

from cellward.operators import clusterfiles, clusters, outlines
from cellward.plans import gridqueries
from cellward.plans.config import ClusterSettings
from cellward.sources.storage import cut, sized


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("name", ["normalise_hazard", "hazard_combine", "elevation_histogram", "dasymetric_share", "mass_conservation"])
def test_the_layer_stays_where_it_is(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = gridqueries.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert joins and all("BuildRight" in line or "__name" in line for line in joins)  # bins of a group may be on either side


def test_values_of_cells_are_not_broadcast_to_clusters(spark):
    """Sixty times sf0.1 had 5.4 million of them, which were taken for under 10 MB."""
    cells = spark.range(400).selectExpr("'risk_gdp' as file", "cast(id / 20 as int) as row", "cast(id % 20 as int) as col", "double(id) as value")
    found = cells.where("value < 50").selectExpr("file", "row", "col", "0 as risk_cluster_id")
    got = clusterfiles.described(found, cells, 30.0)
    assert "SortMergeJoin" in plan(got) and "BroadcastHashJoin" not in plan(got)
    assert [(r.pixel_count, r.max_risk, r.area) for r in got.collect()] == [(49, 49.0, 45_000.0)]


def test_numbers_go_to_cells_and_not_cells_to_numbers(spark):
    rows = [(r, c) for r in range(30) for c in range(30) if r % 3 and c % 4]
    got = outlines.finalised(spark.createDataFrame(rows, "row int, col int"), 0.1, 0.0, 30.0, 16)
    joins = [line for line in plan(got).splitlines() if "Join" in line]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0]
    assert got.count() == len(rows) and got.select("risk_cluster_id").distinct().count() == 80


def test_a_table_beyond_the_count_is_not_broadcast(spark):
    small, other = spark.range(10), spark.range(20)
    assert "BroadcastHashJoin" in plan(other.join(sized(small, 10), "id"))
    assert "SortMergeJoin" in plan(other.join(sized(small, 9), "id"))


@pytest.fixture
def plans(monkeypatch):
    """The columns and plan of each table that the operators on clusters cut."""
    seen = []

    def noted(df):
        seen.append((df.columns, plan(df)))
        return cut(df)

    for module in (clusters, clusterfiles):
        monkeypatch.setattr(module, "cut", noted)
    return seen


def test_points_cells_and_labels_are_not_broadcast(spark, monkeypatch, plans):
    monkeypatch.setattr(clusters, "MANY", 0)
    points = spark.range(200).selectExpr("id", "double(id % 20) as x", "id * 0.05D as y")
    plans.append((None, plan(clusters.dbscan(points, 1.5, 4))))
    joins = [line for _, p in plans for line in p.splitlines() if "Join" in line]
    hot = [line for line in joins if "Broadcast" in line and "[label" not in line]  # the step from label to label is sized by the joins before it
    assert len(joins) > 12 and len(hot) == 1 and "LeftOuter, BuildRight" in hot[0]  # how many pieces the cells of very many points have


def test_dense_cells_are_not_broadcast(spark, plans):
    cells = spark.range(400).selectExpr("'risk_gdp' as file", "cast(id / 20 as int) as row", "cast(id % 20 as int) as col", "double(id % 20 div 10) as value")
    got = clusterfiles.extracted(cells, 20, 20, ClusterSettings(morphological_closing_disk_size=1), 16)
    dense = next(p for c, p in plans if {"id", "row", "x", "cluster"} <= set(c))
    assert "SortMergeJoin" in dense and "Broadcast" not in dense
    numbered = next(p for c, p in plans if set(c) == {"row", "col", "risk_cluster_id", "file_no"})
    joins = [line for line in numbered.splitlines() if "Join" in line]
    assert len(joins) == 1 and "BuildRight" in joins[0]
    assert [tuple(r) for r in got.groupBy("file", "risk_cluster_id").count().collect()] == [("risk_gdp", 0, 200)]
