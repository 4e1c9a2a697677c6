r"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Vectors are scaled to length 1, where a cosine of at least s is a distance of at most ``sqrt(2 - 2 s)``.  A hash is
``floor((a . v + b) / WIDTH)`` with a of normal numbers (2-stable) and b uniform up to WIDTH; ``plan`` chooses how many
hashes make a code, so that about CROWD far vectors share one, and how many codes (tables) give RECALL at the
similarity.  More vectors get longer codes and more tables (about n ** 0.19 of them).

Equal vectors are one class, which goes through the tables once.  In a table the classes of one code are compared with
each other in double precision; a code of more than BLOCK classes is dealt out in blocks, and every pair of blocks is
work of its own.  A pair counts where it first meets: not where a code of an earlier table is equal, too.  Only counts
and a spanning forest of the links come back, never a list of pairs, so no link that is found gets lost and a group
costs no more rows than it has members in blocks.

Vectors that are null, empty or zero, or that hold null or non-finite components link with nothing, and each is a
component of its own.  Vectors of different lengths never link.  Repeated rows are vectors of their own, which are linked
with each other.  A null vec_id counts as larger than all others; a component of nothing else has a null id, and its rows
are kept.  Other columns are never looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm.graph import components
from cellward.llm.sparkops import NULL_ID, by_group, cut, dealt, salted_join, table

SIMILARITY, RECALL, WIDTH, CROWD = 0.95, 0.9999, 2.0, 256
#: Most hashes in a code.
LONGEST = 32
BLOCK = 512
#: Linked pairs of a block pair whose earlier codes are compared at a time.
PIECE = 1 << 16


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one hash is equal for two vectors at the distance."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL, width: float = WIDTH, crowd: int = CROWD) -> tuple[int, int]:
    """(tables, hashes in a code) for n vectors: orthogonal ones (at distance sqrt 2) share a code with about ``crowd`` others."""
    near, far = collision(math.sqrt(2 - 2 * similarity), width), collision(math.sqrt(2), width)
    hashes = min(LONGEST, max(1, math.ceil(math.log(max(n, 2) / crowd) / -math.log(far))))
    p = near**hashes
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1, hashes


@lru_cache(maxsize=4)
def _functions(length: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and multipliers that make one number of a code; the same in every task."""
    draw = np.random.Generator(np.random.PCG64([length, tables, hashes]))
    directions = draw.standard_normal((length, tables * hashes))
    shifts = draw.uniform(0, width, tables * hashes)
    return directions, shifts, draw.integers(0, 1 << 63, (tables, hashes), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def codes(units: np.ndarray, tables: int, hashes: int, width: float = WIDTH) -> np.ndarray:
    """For each unit vector a 32-bit code in every table."""
    directions, shifts, odd = _functions(units.shape[1], tables, hashes, width)
    cells = np.floor((units @ directions + shifts) / width).astype(np.int64).view(np.uint64).reshape(len(units), tables, hashes)
    mixed = (cells * odd).sum(2, dtype=np.uint64)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def scaled(found: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; first by their largest component, as squares of very large or small numbers would be lost."""
    found = found.astype(np.float64)
    found = found / np.abs(found).max(1, keepdims=True, initial=0)
    return found / np.sqrt((found * found).sum(1, keepdims=True))


def _keyed(kind: str):
    """The vectors that can link as bytes, with a digest of them; null for the others."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            values = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            some = np.append(0, np.cumsum(values != 0))
            ends = np.cumsum(lengths)
            begins = ends - lengths
            ok = (bad[ends] == bad[begins]) & (some[ends] > some[begins])
            raw = values.astype(kind)
            bodies = [raw[x:y].tobytes() if good else None for x, y, good in zip(begins.tolist(), ends.tolist(), ok.tolist())]
            digests = [body and hashlib.blake2b(body, digest_size=16).digest() for body in bodies]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], names=["vec_id", "key", "body"])

    return run


def _sign(kind: str, tables: int, hashes: int, width: float):
    def run(batches):
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                for a in range(0, len(rows), 1024):
                    at = rows[a : a + 1024]
                    found = codes(scaled(np.frombuffer(b"".join(bodies[k] for k in at.tolist()), kind).reshape(len(at), -1)), tables, hashes, width)
                    lists = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * tables).astype(np.int32)), pa.array(found.ravel()))
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["class", "copies", "body", "codes"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """Each vertex's smallest connected vertex, of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        step = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        step = step[step]
        if (step == label).all():
            return label
        label = step


def links_between(x: np.ndarray, y: np.ndarray, earlier_x: np.ndarray, earlier_y: np.ndarray, similarity: float) -> np.ndarray:
    """Matrix of linked pairs, without those that share a code of an earlier table."""
    linked = x @ y.T >= similarity
    i, j = np.nonzero(linked)
    for a in range(0, len(i) if earlier_x.shape[1] else 0, PIECE):
        p, q = i[a : a + PIECE], j[a : a + PIECE]
        for k in range(earlier_x.shape[1]):
            same = earlier_x[p, k] == earlier_y[q, k]
            linked[p[same], q[same]] = False
            p, q = p[~same], q[~same]
    return linked


def _compare(kind: str, similarity: float):
    def run(batch: pa.RecordBatch, bounds: list[int]):
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        ids, copies, blocks, firsts, seconds = (column[c].to_numpy() for c in ("class", "copies", "block", "i", "j"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2:
                continue
            bodies, earlier = column["body"].slice(a, b - a).to_pylist(), column["earlier"].slice(a, b - a)
            earlier = earlier.flatten().to_numpy().reshape(b - a, -1)
            sizes = np.fromiter(map(len, bodies), np.int64, b - a)
            for size in np.unique(sizes).tolist():  # vectors of different lengths can share a code by chance
                own = np.flatnonzero(sizes == size)
                if len(own) < 2:
                    continue
                own = own[np.argsort(ids[a + own])]
                units = scaled(np.frombuffer(b"".join(bodies[k] for k in own.tolist()), kind).reshape(len(own), -1))
                first, second = (np.flatnonzero(blocks[a + own] == side[a]) for side in (firsts, seconds))
                linked = np.zeros((len(own), len(own)), bool)
                linked[np.ix_(first, second)] = links_between(units[first], units[second], earlier[own[first]], earlier[own[second]], similarity)
                linked |= linked.T
                np.fill_diagonal(linked, False)
                some = np.flatnonzero(linked.any(1))
                linked, at = linked[np.ix_(some, some)], a + own[some]
                out.append((ids[at], linked @ copies[at], ids[at][_forest(linked)]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "links", "b"])

    return run


def links(classes: DataFrame, kind: str = "f8", similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Of classes (class, copies, body), each vector once: (class, links), the copies of other classes that those with links
    are linked with, and edges (a, b) that connect what the links connect."""
    tables, hashes = plan(classes.count(), similarity, recall, crowd=crowd)
    signed = cut(classes.select("class", "copies", "body").mapInArrow(_sign(kind, tables, hashes, WIDTH), "class long, copies long, body binary, codes array<int>"))
    rows = signed.select("class", "copies", "body", "codes", F.posexplode("codes").alias("table", "code")).withColumn("earlier", F.slice("codes", F.lit(1), F.col("table"))).drop("codes")
    pairs = dealt(rows, ["table", "code"], "class", block)
    found = cut(by_group(pairs, ["table", "code", "i", "j"], _compare(kind, similarity), "a long, links long, b long"))
    return found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links")), found.where("a <> b").select("a", "b")


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """Of vec_id and embedding (floats or doubles) one row per vector: vec_id, n_links, component_id, kept, as the module says."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "f4" if element == "float" else "f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind == 'f4' else 'double'}>").alias("v"))
    rows = rows.mapInArrow(_keyed(kind), "vec_id long, key binary, body binary")
    own_id = F.coalesce("vec_id", F.lit(NULL_ID))
    classes = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(own_id).alias("own"), F.any_value("body").alias("body"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    counts, edges = links(classes, kind, similarity, recall, block, crowd)
    named = classes.select("class", "key", "copies", "own").join(counts, "class", "left").join(components(edges).withColumnRenamed("v", "class"), "class", "left")
    named = cut(named.select("key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "class").alias("label"), "own"))
    firsts = named.groupBy("label").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("size"))
    named = cut(salted_join(named.select("key", "copies", "n_links", "label"), firsts, "label", "size", ["key"]).select("key", "copies", "n_links", "first"))
    linkable = salted_join(rows.where("key is not null").select("vec_id", "key"), named, "key", "copies", ["vec_id"]).select("vec_id", "n_links", "first")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), own_id.alias("first"))
    return linkable.union(alone).select("vec_id", "n_links", F.nullif(F.col("first"), F.lit(NULL_ID)).alias("component_id"), (own_id == F.col("first")).alias("kept"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
