r"""N-gram Jaccard join by MinHash banding.

A text's set holds its shingles of five words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z; a text
of fewer words has one shingle.  Texts with equal sets are one class, compared once.  ``plan`` chooses bands and
rows for the target recall; classes are shuffled on band hashes, and candidates are verified on full sets.

* Buckets of at most SMALL classes give candidate pairs, verified one by one.
* The classes of larger buckets are banded again with longer bands (of up to FINE hashes, for the same recall), so
  that texts which share no more than a template part.  Small ones of the new buckets give pairs, too; large ones a
  star: each class and the bucket's first.  What these stars connect is a hot group.  It is dealt out in blocks of
  about BLOCK classes, every pair of blocks is compared in a task of its own, and only counts and connections come
  back, so no link is lost and no list of pairs is made.

Links at SIMILARITY or more are joined to connected groups; a group is named by its smallest doc_id.

Texts without words have no links and are each a group of their own.  Null texts are such texts.  Documents
with a null doc_id count as larger than all others.  Repeated rows are copies of each other, as are rows of equal
doc_id and set.  Other columns are carried along and never looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellward.llm import textops as t
from cellward.llm.graph import components
from cellward.llm.sparkops import NULL_ID, carried, cut, free_names, salted_join, table, texts

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Most hash functions that banding may use, and banding again.
HASHES, FINE = 300, 1600
SMALL, BLOCK = 32, 256


def plan(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """The most selective (bands, rows) that finds a pair at the similarity with the recall."""
    best = (1, 1)
    for rows in range(1, 20):
        p = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingle_sets(bodies: list[bytes], n: int = SHINGLE):
    """Different shingles of all texts, sorted within each, and how many each text has."""
    words = t.Words(bodies)
    gram, ok = t.gram_hash(words.hash, n), t.in_one(words.text, n)
    text, h = words.text[: len(gram)][ok], gram[ok]
    for i in np.flatnonzero((words.count > 0) & (words.count < n)).tolist():
        a, b = words.first[i], words.first[i + 1]
        text, h = np.append(text, i), np.append(h, t.gram_hash(words.hash[a:b], int(b - a)))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    text, h = text[new], h[new]
    return h, np.bincount(text, minlength=len(bodies)).astype(np.int64)


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _classes(h: np.ndarray, count: np.ndarray) -> list[int]:
    end = np.cumsum(count)
    return [class_of(h[b - n : b]) for b, n in zip(end.tolist(), count.tolist())]


def band_hashes(h: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band's minima, for every text that has shingles."""
    some = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[some]
    out = np.empty((len(some), bands), np.uint64)
    k = 0
    for b in range(bands):
        acc = np.full(len(some), np.uint64(b + 1))
        for _ in range(rows):
            k += 1
            seed = t.mix(np.array([k, k + (1 << 20)], np.uint64))
            value = ((h ^ seed[0]) * (seed[1] | np.uint64(1))) >> np.uint64(32)
            acc = t.mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, start))
        out[:, b] = acc
    return out


def _sign(bands: int, rows: int, n: int):
    def run(batches):
        for batch, bodies in t.slices(batches):
            h, count = shingle_sets(bodies, n)
            found = band_hashes(h, count, bands, rows).view(np.int64) if len(h) else np.empty((0, bands), np.int64)
            offsets = np.append(0, np.cumsum(np.where(count > 0, bands, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_classes(h, count), pa.int64()), pa.array(count), lists], names=["doc_id", "tid", "cid", "n", "bands"])

    return run


def _sign_sets(bands: int, rows: int):
    """Band hashes of the classes' sets, some hundred classes at a time."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                sets = [np.frombuffer(x, np.uint64) for x in piece.column(1).to_pylist()]
                count = np.fromiter(map(len, sets), np.int64, len(sets))
                found = band_hashes(np.concatenate(sets), count, bands, rows).view(np.int64)
                offsets = (np.arange(len(sets) + 1) * bands).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(count), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], names=["cid", "n", "bands"])

    return run


def sign(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, a hash of the text, class of the set, size of the set, band hashes (none for a text without words)."""
    bands, rows = plan(similarity, recall)
    return texts(docs).withColumn("tid", F.xxhash64("text")).mapInArrow(_sign(bands, rows, n), "doc_id long, tid long, cid long, n long, bands array<long>")


def _sets(n: int):
    def run(batches):
        for batch, bodies in t.slices(batches):
            h, count = shingle_sets(bodies, n)
            end = np.cumsum(count).tolist()
            own = [h[b - c : b] for b, c in zip(end, count.tolist())]
            same = [class_of(x) == c for x, c in zip(own, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() if s else None for x, s in zip(own, same)], pa.binary())], names=["cid", "shingles"])

    return run


def full_sets(docs: DataFrame, members: DataFrame, wanted: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(cid, shingles) of the wanted classes, each from one document of the class."""
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("id")
    one = members.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct(key, "tid")).alias("one")).select("cid", "one.*")
    # the text's hash keeps rows of one doc_id apart; where it can't, the set's class does
    rows = one.join(texts(docs).select(key, F.xxhash64("text").alias("tid"), "text"), ["id", "tid"]).select("cid", "text")
    found = rows.mapInArrow(_sets(n), "cid long, shingles binary").where("shingles is not null")
    return found.groupBy("cid").agg(F.any_value("shingles").alias("shingles"))


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _meet(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, over the shingles that both blocks have."""
    shared = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    out = np.zeros((len(x), len(y)))
    for a in range(0, len(shared), 8192):
        part = shared[a : a + 8192]

        def matrix(sets, part=part):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                at = t.look_up(part, s)
                m[i, at[at >= 0]] = 1
            return m

        out += matrix(x) @ matrix(y).T
    return out


def _blocks(similarity: float):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        frame = frame.sort_values("cid")
        x, y = frame[frame["block"] == i], frame[frame["block"] == j]
        out = {c: [0, c] for c in frame["cid"].tolist()}
        if len(x) and len(y):
            a, b = ([np.frombuffer(s, np.uint64) for s in f["shingles"]] for f in (x, y))
            both = _meet(a, b)
            size = np.array([[len(s)] for s in a]) + np.array([[len(s) for s in b]])
            linked = both >= similarity * (size - both) - 1e-9
            if i == j:
                np.fill_diagonal(linked, False)
            ids = x["cid"].to_numpy(), y["cid"].to_numpy()
            for own, other, m in ((ids[0], ids[1], linked), (ids[1], ids[0], linked.T)) if i != j else ((ids[0], ids[1], linked),):
                for c, row in zip(own.tolist(), m):
                    out[c][0] += int(row.sum())
            # a spanning forest of the block pair's links
            label = {c: c for c in out}

            def root(c):
                while label[c] != c:
                    label[c] = label[label[c]]
                    c = label[c]
                return c

            for c, row in zip(ids[0].tolist(), linked):
                for d in ids[1][row].tolist():
                    p, q = root(c), root(d)
                    label[max(p, q)] = min(p, q)
            for c in out:
                out[c][1] = root(c)
        return pd.DataFrame({"a": list(out), "links": [v[0] for v in out.values()], "b": [v[1] for v in out.values()]})

    return run


def _buckets(rows: DataFrame) -> DataFrame:
    """Of (cid, n, bands) all (h, cid, n) that share h with others, with the size of that bucket and its first class."""
    rows = rows.select("cid", "n", F.explode("bands").alias("h"))
    return cut(rows.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("first")).where("size > 1"), "h"))


def _pairs(few: DataFrame, similarity: float) -> DataFrame:
    """Pairs within small buckets of which the sets' sizes allow a link."""
    one, other = (few.select("h", F.col("cid").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    return one.join(other, "h").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb"))).select("a", "b")


def links(docs: DataFrame, members: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(cid, links) of all classes that have links, and edges (a, b) that connect the same classes as the links do."""
    classes = members.where("n > 0").groupBy("cid").agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    rows = _buckets(classes)
    large = cut(rows.where(F.col("size") > small).select("cid").distinct())
    large_sets = cut(full_sets(docs, members, large, n))
    again = _buckets(large_sets.mapInArrow(_sign_sets(*plan(similarity, recall, FINE)), "cid long, n long, bands array<long>"))
    star = again.where(F.col("size") > small).select(F.col("cid").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
    hot = components(star).select(F.col("v").alias("cid"), F.col("label").alias("hot"))
    is_small = F.col("size") <= small
    pairs = (
        _pairs(rows.where(is_small), similarity)
        .union(_pairs(again.where(is_small), similarity))
        .distinct()
        .join(hot.select(F.col("cid").alias("a"), F.col("hot").alias("ha")), "a", "left")
        .join(hot.select(F.col("cid").alias("b"), F.col("hot").alias("hb")), "b", "left")
        .where("ha is null or hb is null or ha <> hb")
        .select("a", "b")
    )
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct().join(large, "cid", "left_anti")
    sets = cut(full_sets(docs, members, wanted, n)).union(large_sets)
    found = (
        pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_verify(similarity), "a long, b long")
    )
    found = cut(found)
    sizes = hot.groupBy("hot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = hot.join(sizes, "hot").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets, "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.select("hot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "shingles")
    within = cut(groups.groupBy("hot", "i", "j").applyInPandas(_blocks(similarity), "a long, links long, b long"))
    counts = found.select(F.col("a").alias("cid"), F.lit(1).alias("links")).union(found.select(F.col("b").alias("cid"), F.lit(1).alias("links"))).union(within.select(F.col("a").alias("cid"), "links"))
    edges = found.union(within.where("a <> b").select("a", "b"))
    return counts.groupBy("cid").agg(F.sum("links").cast("long").alias("links")).where("links > 0"), edges


def groups(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, cid, class_id (smallest doc_id of its group), n_links (other texts it is linked
    with), n_copies (documents with its very set of shingles, itself included), first_id (as class_id, with
    NULL_ID for null), first_cid (of the group's texts that have first_id, the one with the smallest cid)."""
    members = cut(sign(docs, n, similarity, recall))
    counts, edges = links(docs, members, n, similarity, recall, small, block)
    label = components(edges)
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    classes = members.where("n > 0").groupBy("cid").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("n_copies"))
    classes = classes.join(counts, "cid", "left").join(label.withColumnRenamed("v", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    first = classes.groupBy("label").agg(F.min(F.struct("id", "cid")).alias("first")).select("label", F.col("first.id").alias("first_id"), F.col("first.cid").alias("first_cid"))
    classes = cut(classes.join(first, "label").select("cid", "first_id", "first_cid", "n_copies", F.coalesce("links", F.lit(0)).alias("n_links")))
    worded = salted_join(members.where("n > 0").select("doc_id", "cid", "tid"), classes, "cid", "n_copies", ["doc_id", "tid"])
    empty = members.where("n = 0").select("cid", "doc_id", key.alias("first_id"), F.col("cid").alias("first_cid"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    out = worded.select("cid", "doc_id", "first_id", "first_cid", "n_copies", "n_links").union(empty)
    return out.withColumn("class_id", F.nullif(F.col("first_id"), F.lit(NULL_ID)))


def _name(n: int, names: list[str], body: str, cid: str):
    def run(batches):
        for batch, bodies in t.slices(batches, body):
            h, count = shingle_sets(bodies, n)
            found = [c if k else None for c, k in zip(_classes(h, count), count.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.int64())], names=[*names, cid])

    return run


def keep_first(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with its own columns, whatever those are called.

    All documents without words stay.  Of several texts with that doc_id the one with the smallest class stays, and of
    several rows of that doc_id and class the one with the smallest text, then with the smallest other columns as JSON.
    """
    return carried(docs, lambda own: _first(own, n, similarity))


def _first(docs: DataFrame, n: int, similarity: float) -> DataFrame:
    names = docs.columns
    body, cid, own_id = free_names([*names, "struct"], "body", "cid", "id")
    kept = groups(docs, n, similarity).where(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)) == F.col("first_id")).where("cid = first_cid")
    kept = cut(kept.select(F.col("first_id").alias(own_id), F.col("cid").alias(cid)).distinct())
    rows = docs.select("*", F.col("text").cast("string").alias(body))
    named = rows.mapInArrow(_name(n, names, body, cid), T.StructType([*docs.schema.fields, T.StructField(cid, T.LongType())]))
    named = named.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    worded = named.where(F.col(cid).isNotNull()).join(kept, [own_id, cid], "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in names))
    first = worded.groupBy(own_id, cid).agg(F.min_by(whole, F.struct(F.col("text").cast("string").alias("text"), F.to_json(whole).alias("rest"))).alias("struct"))
    return first.select("struct.*").union(named.where(F.col(cid).isNull()).select(*names))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
