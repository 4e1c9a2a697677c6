"""Linked vectors against the cosines of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellward.llm import graph, vectors
from cellward.llm.sparkops import table

SCHEMA = "vec_id long, embedding array<double>, label int, `key` string, links int"


def brute(rows, similarity=0.95):
    """(vec_id, n_links, component_id, kept) of every row; null ids count as larger than all others."""
    n = len(rows)
    units = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    by_size = {}
    for k, u in enumerate(units):
        if u is not None:
            by_size.setdefault(len(u), []).append(k)
    links, label = [0] * n, list(range(n))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for own in by_size.values():
        m = np.array([units[k] for k in own])
        linked = m @ m.T >= similarity
        for a, k in enumerate(own):
            links[k] = int(linked[a].sum()) - 1
            for b in np.flatnonzero(linked[a, :a]).tolist():
                label[root(k)] = root(own[b])
    key = lambda k: math.inf if rows[k][0] is None else rows[k][0]
    least = {}
    for k in range(n):
        least[root(k)] = min(least.get(root(k), math.inf), key(k))
    out = [(rows[k][0], links[k], None if least[root(k)] == math.inf else least[root(k)], least[root(k)] == key(k)) for k in range(n)]
    return sorted(out, key=str)


def clouds(seed, n, size=24):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((n // 12 + 1, size))
    rows = [centres[draw.integers(len(centres))] + draw.standard_normal(size) * draw.choice([0.05, 0.2, 0.3, 1]) for _ in range(n)]
    return [(k, [float(x) * float(draw.choice([1, 7])) for x in v]) for k, v in enumerate(rows)]


@pytest.mark.parametrize(("block", "crowd"), [(512, 256), (16, 20)])
def test_all_links_within_blocks_and_tables(spark, block, crowd):
    rows = clouds(block + crowd, 400)
    rows += [(1000 + k, rows[3][1]) for k in range(70)]  # copies
    rows += [(2000 + k, [x * (1 + 1e-4 * ((k + i) % 5)) for i, x in enumerate(rows[5][1])]) for k in range(90)]  # a large group of near copies
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block, crowd=crowd).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_recall_is_as_planned():
    draw = np.random.default_rng(1)
    for n in (100, 50_000, 10**8):
        tables, hashes = vectors.plan(n)
        assert 1 - (1 - vectors.collision(math.sqrt(0.1)) ** hashes) ** tables >= vectors.RECALL
    tables, hashes = vectors.plan(50_000)
    x = vectors.scaled(draw.standard_normal((4000, 64)))
    side = draw.standard_normal((4000, 64))
    side = vectors.scaled(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * side  # at the similarity itself
    found = (vectors.codes(x, tables, hashes) == vectors.codes(vectors.scaled(y), tables, hashes)).any(1)
    assert found.mean() > 0.999
    far = vectors.codes(x, tables, hashes)[:, 0]
    assert (far[:2000] == far[2000:]).mean() < 0.02


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (None, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, math.nan, 3.0])]
    rows += [(8, [math.inf, 2.0, 3.0]), (9, [-1.0, -2.0, -3.0]), (10, [1.0, 2.0, 3.0, 0.0]), (11, [1e300, 2e300, 3e300]), (12, [1e-300, 2e-300, 3e-300]), (13, [5.0]), (14, [7.0]), (None, [0.0]), (9, [3.0, -2.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = vectors.near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    norm = np.linalg.norm
    np.linalg.norm = lambda a: norm(a / np.abs(a).max()) * np.abs(a).max()
    try:
        want = brute(rows)
    finally:
        np.linalg.norm = norm
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert vectors.near_vectors(df.where("false")).count() == 0
    floats = df.where("vec_id in (9, 10, 13, 14)").withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert sorted(r.n_links for r in vectors.near_vectors(floats).collect()) == [0, 0, 0, 1, 1]


def test_query_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, vectors.op13_embedding_near_dedup(spark, folder).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("few", [0, 1000])
def test_components_with_hubs(spark, few):
    edges = [(5, k) for k in range(10, 300)] + [(k, k + 1) for k in range(1000, 1400)] + [(7, 7), (1, 2), (2, 1)]
    got = {r.v: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {5: 5} | dict.fromkeys(range(10, 300), 5) | dict.fromkeys(range(1000, 1401), 1000) | {1: 1, 2: 1}
    assert graph.components(spark.createDataFrame([], "a long, b long"), few).count() == 0
