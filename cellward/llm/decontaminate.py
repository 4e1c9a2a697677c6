r"""Benchmark decontamination by winnowing.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  The fingerprint of a text is, of every
window of ``SPAN`` words, the rightmost smallest hash of a ``GRAM``-word gram in it.  Two texts that share SPAN
words choose the same gram in that window, so joining the fingerprints misses no shared span.  Each hit is
extended: the windows of SPAN words around it are joined with the items' windows, word by word, and all words of a
matching window are hit.  Items of fewer than SPAN words are one window each, which is its own fingerprint.

Documents and benchmark are both tables of fingerprints and windows.  Before anything is shuffled, a document's
fingerprints and windows pass two bit sets of the benchmark's hashes, of a size that follows the benchmark up to
BITS bits each; these let through all that is in the benchmark and, the larger it is, something besides, which the
joins then drop.  Equal texts are worked on once.

Nulls: a null text has no words; a null doc_id is kept as it is; null items have no words.  Windows of items with a
null item_id are hit like others, but such items aren't counted or listed.  Repeated documents give one row
each.  An item_id that occurs in several rows counts once.  Other columns are carried along and never looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm import textops as t
from cellward.llm.sparkops import carried, cut, free_names, salted_join, sized, table, texts

SPAN, GRAM = 13, 8
#: Bits of a bit set at most (32 MB), and of one row of it.
BITS, SEGMENT = 1 << 28, 1 << 17
#: Benchmark windows, fingerprints and contaminated texts that are broadcast (under 100 bytes each); more are joined by shuffle.
SENT = 200_000


def winnow(grams: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Places of the rightmost smallest gram in every window of ``width`` grams within one text."""
    m = len(grams) - width + 1
    if m <= 0:
        return np.empty(0, np.int64)
    best, value = np.arange(m), grams[:m].copy()
    for i in range(1, width):
        less = grams[i : i + m] <= value
        best = np.where(less, np.arange(i, i + m), best)
        value = np.where(less, grams[i : i + m], value)
    return np.unique(best[text[:m] == text[width - 1 : width - 1 + m]])


def _window_hash(words: t.Words, length: int) -> np.ndarray:
    return t.mix(t.gram_hash(words.hash, length) ^ t.mix(np.array([length], np.uint64)))


def _fingerprints(words: t.Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the chosen grams of all texts of SPAN words or more."""
    h, whole = t.gram_hash(words.hash, gram), t.in_one(words.text, gram)
    picked = winnow(np.where(whole, h, np.iinfo(np.uint64).max), words.text[: len(h)], span - gram + 1)
    return picked, h[picked]


def _string(words: t.Words, at: int, length: int) -> str:
    return b" ".join(map(words.word, range(at, at + length))).decode("utf-8", "replace")


def _item_rows(span: int, gram: int):
    def run(batches):
        for batch, bodies in t.slices(batches):
            words, rows, ids = t.Words(bodies), [], batch.column(0).to_pylist()
            for _, h in zip(*_fingerprints(words, span, gram)):
                rows.append((None, h.astype(np.int64), None, None, None))
            for length in sorted({int(min(span, c)) for c in words.count if c}):
                own = words.count >= span if length == span else words.count == length
                h, ok = _window_hash(words, length), t.in_one(words.text, length)
                for at in np.flatnonzero(ok & own[words.text[: len(h)]]).tolist():
                    code = h[at].astype(np.int64)
                    rows.append((ids[int(words.text[at])], None if length == span else code, code, _string(words, at, length), length))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["item_id", "fp", "code", "words", "length"])

    return run


def _bits(hashes: DataFrame, size: int) -> np.ndarray:
    """Bit set of the hashes; its rows are put together by range, so only the ``size`` bits come to the driver."""

    def run(block: pa.Table) -> pa.Table:
        segment, at = block["segment"][0].as_py(), block["at"].to_numpy()
        flags = np.zeros(min(SEGMENT, size), np.uint8)
        flags[at] = 1
        return pa.table({"segment": pa.array([segment], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    place = F.col("h").bitwiseAND(F.lit(size - 1))
    at = hashes.select(F.floor(place / SEGMENT).cast("int").alias("segment"), (place % SEGMENT).cast("int").alias("at")).distinct()
    out = np.zeros(size // 8, np.uint8)
    for row in at.groupBy("segment").applyInArrow(run, "segment int, bits binary").toLocalIterator():
        out[row.segment * SEGMENT // 8 :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


class Benchmark:
    """The benchmark as tables: ``prints`` (fp), ``windows`` (words, items: a digest of the ids) and ``items`` (items, ids)."""

    def __init__(self, benchmark: DataFrame, span: int, gram: int, sent: int, most: int):
        source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        rows = cut(source.mapInArrow(_item_rows(span, gram), "item_id long, fp long, code long, words string, length int"))
        self.lengths = sorted(r.length for r in rows.where("length is not null").select("length").distinct().collect())  # SPAN of them at most
        prints = rows.where("fp is not null").select("fp").distinct()
        listed = rows.where("words is not null").groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
        listed = cut(listed.select("words", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("items"), "ids"))
        self.prints, self.windows = sized(prints, sent), sized(listed.select("words", "items"), sent)
        self.items = listed.groupBy("items").agg(F.any_value("ids").alias("ids"))
        size = 1 << 10
        n = rows.count()
        while size < min(16 * n, most):
            size *= 2
        codes = rows.where("code is not null").select(F.col("code").alias("h"))
        self.bits = _bits(prints.select(F.col("fp").alias("h")), size), _bits(codes, size)


def _marker(sent, lengths: list[int], span: int, gram: int):
    """For each text its number of words and the windows to look at, with the fingerprint that each was found by."""

    def mark(bodies: list[bytes]):
        prints, windows = sent.value
        words = t.Words(bodies)
        seeds: list[list[dict]] = [[] for _ in bodies]
        for length in lengths:
            h, ok = _window_hash(words, length), t.in_one(words.text, length)
            if not len(h):
                continue
            if length == span:
                place, fp = _fingerprints(words, span, gram)
                hit = _has(prints, fp)
                back = span - gram + 1
                at, fp = (place[hit][:, None] - np.arange(back)).ravel(), np.repeat(fp[hit], back)
                inside = (at >= 0) & (at < len(h))
                at, fp = at[inside], fp[inside]
            else:
                at, fp = np.arange(len(h)), h
            good = ok[at] & _has(windows, h[at])
            for i, f in zip(at[good].tolist(), fp[good].astype(np.int64).tolist()):
                text = int(words.text[i])
                seeds[text].append({"fp": f, "start": i - int(words.first[text]), "length": length, "words": _string(words, i, length)})
        return words.count, seeds

    return mark


_SEED = pa.list_(pa.struct([("fp", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("words", pa.string())]))


def marked(docs: DataFrame, items: Benchmark, span: int, gram: int) -> DataFrame:
    """doc_id, n_words, and for texts with windows to look at the text's SHA-256 as ``key`` and these as ``seeds``."""
    mark = _marker(docs.sparkSession.sparkContext.broadcast(items.bits), items.lengths, span, gram)

    def run(batches):
        for batch, bodies in t.slices(batches):
            count, seeds = mark(bodies)
            keys = [hashlib.sha256(b).digest() if s else None for b, s in zip(bodies, seeds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(keys, pa.binary()), pa.array([s or None for s in seeds], _SEED)], names=["doc_id", "n_words", "key", "seeds"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, key binary, seeds array<struct<fp:bigint,start:int,length:int,words:string>>")


_COVERED = """aggregate(sort_array(spans), named_struct('n', 0L, 'upto', 0), (a, s) -> named_struct(
    'n', a.n + greatest(0, s.start + s.length - greatest(a.upto, s.start)), 'upto', greatest(a.upto, s.start + s.length)), a -> a.n)"""


def hits(found: DataFrame, items: Benchmark) -> DataFrame:
    """key, n_words, copies, n_hit and sets (digests of the items found) of each different text with hits."""
    one = cut(found.where("key is not null").groupBy("key").agg(F.any_value("seeds").alias("seeds"), F.any_value("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies")))
    met = one.select("key", F.explode("seeds").alias("s")).select("key", "s.*").join(items.prints, "fp", "left_semi")
    spans = met.select("key", "start", "length", "words").distinct().join(items.windows, "words")
    by = spans.groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.sort_array(F.collect_set("items")).alias("sets"))
    return one.select("key", "n_words", "copies").join(by.select("key", F.expr(_COVERED).alias("n_hit"), "sets"), "key")


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, sent: int = SENT, most: int = BITS) -> DataFrame:
    """For each document its words inside occurrences of benchmark windows and the items found."""
    items = Benchmark(benchmark, span, gram, sent, most)
    rows = cut(marked(docs, items, span, gram))
    found = cut(hits(rows, items))
    # items are listed once for each different set of sets
    sets = found.select("sets").distinct()
    listed = sets.select("sets", F.explode("sets").alias("items")).join(items.items, "items").select("sets", F.explode("ids").alias("id")).distinct()
    listed = listed.groupBy("sets").agg(F.count("id").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("id").cast("string"))), ",").alias("names"))
    found = cut(found.join(listed, "sets", "left").select("key", "copies", "n_hit", "n_items", "names"))
    some = salted_join(rows.where("key is not null").select("doc_id", "n_words", "key"), found, "key", "copies", ["doc_id"])
    some = some.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("names", F.lit("")).alias("names"))
    none = rows.where("key is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("names"))
    return some.union(none).select("doc_id", "n_words", "n_hit", "n_items", F.sha2("names", 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, sent: int = SENT, most: int = BITS) -> DataFrame:
    """The documents that aren't contaminated, with their own columns, whatever those are called."""
    items = Benchmark(benchmark, span, gram, sent, most)
    return carried(docs, lambda own: _without(own, items, span, gram, sent))


def _without(docs: DataFrame, items: Benchmark, span: int, gram: int, sent: int) -> DataFrame:
    (key,) = free_names([*docs.columns, "key"], "digest")
    bad = hits(marked(docs, items, span, gram), items).where("20 * n_hit >= n_words").select(F.col("key").alias(key))
    rows = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    return rows.join(sized(bad, sent), key, "left_anti").select(*docs.columns)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by plain string windows.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
