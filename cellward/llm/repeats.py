r"""Suffix-array deduplication: remove bytes of strings that a document with a smaller doc_id has.

A string of LENGTH bytes is compared by way of one suffix: the one at its anchor, the rightmost smallest hash of
a GRAM-byte gram in it.  Equal strings have equal anchors, so a sparse suffix array of the anchored suffixes,
each with the bytes left of it, decides all strings, and is far smaller than one of all suffixes.

1. Every document's anchor hashes go to buckets in packed blocks; what only one document has is dropped, and a hash
   with more than HOT suffixes is marked with the number of pieces that its suffixes are dealt to.
2. The other suffixes are range-partitioned by their leading GRAM bytes with splitters from a sample of documents (it
   only balances the buckets), so suffixes that share a whole gram lie in one bucket, or in the pieces of a hot one.
3. A bucket or piece sorts its suffixes by multikey quicksort, 8 bytes a key (``multikey_sort``), and likewise the
   reversed bytes to the left; the lengths of common prefixes of neighbours then number the equal strings exactly,
   and the smallest doc_id of each is compared with its holders'.
4. Pieces are compared across their boundaries: whoever has a string's smallest doc_id in a piece is still open and
   is compared with the smallest of all pieces, by a 128-bit digest of the string.
5. The removed ranges go back to the documents.

A group of equal grams has one suffix for each document and place, without the rest of the texts, and counts
of rows grow with the text only: no pairs are made.

Null texts are empty.  A null doc_id counts as larger than all others, and documents without one don't remove
from each other; nor do rows of equal doc_id, which are one document.  Rows of a doc_id that several rows have, or of
none, are told apart by the SHA-256 of their text; rows equal in both get the same result.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm import textops as t
from cellward.llm.sparkops import NULL_ID, cut, freed, partitions, table

LENGTH, GRAM = 50, 24
#: Documents of the sample (as many as buckets if those are more), and suffixes of each.
SAMPLE, LEADS = 1000, 64
#: Slices whose anchors are packed together, suffixes that are, and buckets for each shuffle partition.
HOLD, HELD, BUCKETS = 16, 1 << 20, 4
#: Suffixes of one gram that stay in one task, about 300 bytes each.
HOT = 4096
#: Bytes of a hash that are shuffled.  Equal ones of different hashes only let a suffix through that matches none.
PRINT = 5
_LOW = np.uint64((1 << 32) - 1)


def anchors(bodies: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """For all anchors: its text, its place in the buffer, first and last start of its strings, hash; then the buffer and the texts' starts."""
    raw, start, end = t.joined(bodies)
    n, width = len(raw), length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, np.empty(0, np.uint64), raw, start
    h = t.Rolling(raw).grams(gram)
    key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is smallest
    best, size = key, 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    inside = np.zeros(n + 1, np.int32)
    long = end - start >= length
    np.add.at(inside, start[long], 1)
    np.add.at(inside, end[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: n - length + 1]) > 0)
    if not len(at):
        return none, none, none, none, np.empty(0, np.uint64), raw, start
    place = (_LOW - (best[at] & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    last = np.append(first[1:] - 1, len(at) - 1)
    a = place[first]
    return np.searchsorted(start, a, "right") - 1, a, at[first], at[last], h[a], raw, start


_ZIP = zstandard.ZstdCompressor(level=3)


def _pack(x: np.ndarray) -> bytes:
    return _ZIP.compress(x.tobytes())


def _unpack(blocks: pa.ChunkedArray, kind) -> np.ndarray:
    d = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(d.decompress(x), kind) for x in blocks.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _short(h: np.ndarray) -> bytes:
    """The low PRINT bytes of hashes; the bucket's number, from higher bits, tells the rest that matters."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PRINT].tobytes()


def _long(prints: bytes) -> np.ndarray:
    wide = np.zeros((len(prints) // PRINT, 8), np.uint8)
    wide[:, :PRINT] = np.frombuffer(prints, np.uint8).reshape(-1, PRINT)
    return wide.view("<u8").ravel()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _by(keys: np.ndarray, more: np.ndarray | None = None):
    """The order that groups equal keys (and equal rows of ``more``), and (first index, from, to) of each group in it."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((*more.T, keys))
    if not len(keys):
        return order, zip((), (), ())
    k = keys[order]
    new = np.append(True, k[1:] != k[:-1])
    if more is not None:
        m = more[order]
        new[1:] |= (m[1:] != m[:-1]).any(axis=1)
    cuts = np.flatnonzero(new)
    return order, zip(order[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(k)])


#: A row's key beside its doc_id: 32 bytes as four numbers, all 0 where the doc_id tells it apart.
_KEY = 4


def _keys(column: pa.Array) -> np.ndarray | None:
    """Keys of a batch's rows; None if all are 0."""
    found = column.to_pylist()
    return np.frombuffer(b"".join(x or bytes(8 * _KEY) for x in found), np.uint64).reshape(-1, _KEY) if any(found) else None


def _pack_keys(keys: np.ndarray | None) -> bytes:
    return b"" if keys is None or not keys.any() else _pack(keys)


def _unpack_keys(blocks: pa.ChunkedArray, sizes: list[int]) -> np.ndarray | None:
    found = blocks.to_pylist()
    if not any(found):
        return None
    d = zstandard.ZstdDecompressor()
    return np.concatenate([np.frombuffer(d.decompress(x), np.uint64).reshape(-1, _KEY) if x else np.zeros((n, _KEY), np.uint64) for x, n in zip(found, sizes)])


def _stack(parts: list, sizes: list[int]) -> np.ndarray | None:
    if all(x is None for x in parts):
        return None
    return np.concatenate([np.zeros((n, _KEY), np.uint64) if x is None else x for x, n in zip(parts, sizes)])


def _batch(rows: list[tuple], schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(schema.values())], names=list(schema))


_PRINTS = {"bucket": pa.int32(), "ids": pa.binary(), "keys": pa.binary(), "times": pa.binary(), "prints": pa.binary()}
_REPEATED = {"did": pa.int64(), "key": pa.binary(), "prints": pa.binary()}
_SUFFIXES = {"bucket": pa.int64(), **dict.fromkeys(("did", "keys", "place", "most", "least", "context"), pa.binary())}
_MATCHED = {"did": pa.int64(), "key": pa.binary(), "spans": pa.binary(), "digest": pa.binary()}


def _print_blocks(buckets: int, length: int, gram: int):
    def run(batches):
        held: list = []

        def flush():
            ids, h, times = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
            keys = _stack([x[3] for x in held], [len(x[0]) for x in held])
            held.clear()
            number = _bucket(h, buckets)
            order, groups = _by(number)
            rows = []
            for i, x, y in groups:
                o = order[x:y]
                rows.append((int(number[i]), _pack(ids[o]), _pack_keys(None if keys is None else keys[o]), _pack(times[o]), _short(h[o])))
            return _batch(rows, _PRINTS)

        for batch, bodies in t.slices(batches):
            text, _, _, _, h, _, _ = anchors(bodies, length, gram)
            if len(h):
                ids, keys = batch.column(0).to_numpy(zero_copy_only=False), _keys(batch.column(1))
                order = np.lexsort((h, text))
                i, h = text[order], h[order]
                first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (h[1:] != h[:-1])))
                times = np.minimum(np.diff(np.append(first, len(h))), 0xFFFF).astype(np.uint16)
                i, h = i[first], h[first]
                held.append((ids[i], h, times, None if keys is None else keys[i]))
                if len(held) >= HOLD:
                    yield flush()
        if held:
            yield flush()

    return run


def _repeated(hot: int):
    """Of a bucket's hashes, those that several documents have, by document, each with the power of 2 of its pieces."""

    def run(block: pa.Table) -> pa.Table:
        ids, times = _unpack(block["ids"], np.int64), _unpack(block["times"], np.uint16)
        prints = block["prints"].to_pylist()
        keys = _unpack_keys(block["keys"], [len(x) // PRINT for x in prints])
        h = _long(b"".join(prints))
        order = np.argsort(h)
        h, ids, times = h[order], ids[order], times[order].astype(np.int64)
        keys = None if keys is None else keys[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        several = np.repeat(np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first), size)
        pieces = np.ceil(np.log2(np.maximum(np.add.reduceat(times, first) / hot, 1))).astype(np.uint8)
        h, ids, pieces = h[several], ids[several], np.repeat(pieces, size)[several]
        keys = None if keys is None else keys[several]
        order, groups = _by(ids, keys)
        bucket = struct.pack("<i", block["bucket"][0].as_py() if len(block) else 0)
        rows = []
        for i, x, y in groups:
            o = order[x:y]
            rows.append((int(ids[i]), _name(keys, i), bucket + _short(h[o]) + pieces[o].tobytes()))
        return pa.Table.from_batches([_batch(rows, _REPEATED)])

    return run


def _name(keys: np.ndarray | None, i: int) -> bytes:
    return keys[i].tobytes() if keys is not None and keys[i].any() else b""


def _lead(raw: np.ndarray, a: np.ndarray, gram: int) -> np.ndarray:
    """The grams at the given places, in an order of their own that equal grams share."""
    return raw[a[:, None] + np.arange(gram)].astype(np.uint8).view(f"S{gram}").ravel()


def _sample(length: int, gram: int):
    def run(batches):
        for _, bodies in t.slices(batches):
            _, a, _, _, _, raw, _ = anchors(bodies, length, gram)
            if len(a):
                step = max(1, len(a) // (LEADS * len(bodies)))
                yield pa.RecordBatch.from_arrays([pa.array(_lead(raw, a[::step], gram).tolist(), pa.binary())], names=["lead"])

    return run


def splitters(docs: DataFrame, buckets: int, length: int, gram: int) -> np.ndarray:
    """Leads that part the suffixes of a sample of documents evenly."""
    n, wanted = docs.count(), max(SAMPLE, buckets)
    some = docs.sample(min(1.0, wanted / max(n, 1)), seed=1) if n > wanted else docs
    leads = np.sort(np.array(some.mapInArrow(_sample(length, gram), "lead binary").toArrow()["lead"].to_pylist(), f"S{gram}"))
    return np.unique(leads[np.linspace(0, len(leads) - 1, buckets + 1).astype(int)[1:-1]]) if len(leads) else leads


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indexes of the given ranges, one after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def _suffix_blocks(sent, buckets: int, length: int, gram: int):
    def run(batches):
        cuts, held = sent.value, []

        def flush():
            bucket, did, place, most, least, size = (np.concatenate([x[i] for x in held]) for i in range(6))
            keys = _stack([x[6] for x in held], [len(x[0]) for x in held])
            context = np.concatenate([x[7] for x in held])
            held.clear()
            start = np.cumsum(size) - size
            order, groups = _by(bucket)
            rows = []
            for i, x, y in groups:
                o = order[x:y]
                packed = (_pack(did[o]), _pack_keys(None if keys is None else keys[o]), *(_pack(c[o]) for c in (place, most, least)))
                rows.append((int(bucket[i]), *packed, _pack(context[_ranges(start[o], size[o])])))
            return _batch(rows, _SUFFIXES)

        n_held = 0
        for batch, bodies in t.slices(batches):
            lists = batch.column(3).to_pylist()
            some = [i for i, x in enumerate(lists) if x]
            if not some:
                continue
            bodies, ids, keys = [bodies[i] for i in some], batch.column(0).to_numpy(zero_copy_only=False)[some].astype(np.int64), _keys(batch.column(1))
            keys = None if keys is None else keys[some]
            text, a, lo, hi, h, raw, start = anchors(bodies, length, gram)
            # a hash counts for its own document, in its own bucket
            low, bucket = h & np.uint64((1 << (8 * PRINT)) - 1), _bucket(h, buckets)
            name = t.mix(low ^ t.mix((bucket + buckets * text).astype(np.uint64)))
            parts = [p for j in some for p in lists[j]]
            owner = np.repeat(np.arange(len(some)), [len(lists[j]) for j in some])
            place = np.frombuffer(b"".join([p[:4] for p in parts]), "<i4") + buckets * owner
            times = (np.fromiter(map(len, parts), np.int64, len(parts)) - 4) // (PRINT + 1)
            ends = [4 + PRINT * n for n in times.tolist()]
            wanted = t.mix(_long(b"".join([p[4:e] for p, e in zip(parts, ends)])) ^ np.repeat(t.mix(place.astype(np.uint64)), times))
            pieces = np.frombuffer(b"".join([p[e:] for p, e in zip(parts, ends)]), np.uint8)
            order = np.argsort(wanted)
            found = t.look_up(wanted[order], name)
            kept, found = np.flatnonzero(found >= 0), found[found >= 0]
            pieces = pieces[order][found].astype(np.uint64)
            for x in range(0, len(kept), HELD):
                o, p = kept[x : x + HELD], pieces[x : x + HELD]
                own, at, first, last = text[o], a[o], lo[o], hi[o]
                bucket = np.searchsorted(cuts, _lead(raw, at, gram), "right").astype(np.int64)
                salt = t.mix(ids[own].view(np.uint64) ^ t.mix((at - start[own]).astype(np.uint64))) & ((np.uint64(1) << p) - np.uint64(1))
                bucket = np.where(p > 0, -1 - (t.mix(h[o] ^ t.mix(salt + np.uint64(1))) >> np.uint64(2)).astype(np.int64), bucket)
                size = last - first + length
                held.append((bucket, ids[own], at - start[own], (at - first).astype(np.uint8), (at - last).astype(np.uint8), size, None if keys is None else keys[own], raw[_ranges(first, size)]))
                n_held += len(o)
                if len(held) >= HOLD or n_held >= HELD:
                    yield flush()
                    n_held = 0
        if held:
            yield flush()

    return run


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows: by 8 bytes, then the ties by the next 8, and so on."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, group, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for d in range(words.shape[1]):
        if not len(tied):
            break
        inner = np.lexsort((words[order[tied], d], group[tied]))
        order[tied] = order[tied[inner]]
        w, g = words[order[tied], d], group[tied]
        new = np.append(True, (w[1:] != w[:-1]) | (g[1:] != g[:-1]))
        group[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted row with the one before (0 for the first)."""
    s = rows[order]
    unlike = s[1:] != s[:-1]
    return np.append(0, np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1]))


def _match(length: int, gram: int):
    """The removed ranges of a bucket's documents, and in a piece of a hot gram what other pieces have to say, by digest."""

    def run(block: pa.Table) -> pa.Table:
        did, place, most, least = (_unpack(block[c], kind) for c, kind in (("did", np.int64), ("place", np.int64), ("most", np.uint8), ("least", np.uint8)))
        d = zstandard.ZstdDecompressor()
        keys = _unpack_keys(block["keys"], [len(d.decompress(x)) for x in block["most"].to_pylist()])
        most, least = most.astype(np.int64), least.astype(np.int64)
        context = _unpack(block["context"], np.uint8)
        size = most - least + length
        at = np.cumsum(size) - size + most  # of the anchor in the contexts
        order = np.argsort(did, kind="stable")
        did, place, most, least, at = (x[order] for x in (did, place, most, least, at))
        keys = None if keys is None else keys[order]
        n, left_width, piece = len(did), length - gram, len(block) and block["bucket"][0].as_py() < 0
        padded = np.concatenate([np.zeros(left_width, np.uint8), context, np.zeros(length, np.uint8)])
        right = padded[left_width + at[:, None] + np.arange(length)]
        right[np.arange(length) >= (length - least)[:, None]] = 0
        left = padded[left_width + at[:, None] - 1 - np.arange(left_width)]
        left[np.arange(left_width) >= most[:, None]] = 0
        to_right, to_left = multikey_sort(right), multikey_sort(left)
        same_right, same_left = _common(right, to_right), _common(left, to_left)
        low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        number = np.empty(n, np.int64)
        rows = []
        for j in range(left_width + 1):
            own = np.flatnonzero((least <= j) & (j <= most))
            if not len(own):
                continue
            number[to_right] = np.cumsum(same_right < length - j)
            key = number[own] * (n + 1)
            if j:
                number[to_left] = np.cumsum(same_left < j)
                key += number[own]
            o = np.argsort(key, kind="stable")  # of equal strings the smallest doc_id stands first
            k, owner = key[o], did[own[o]]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            smallest = np.repeat(owner[first], np.diff(np.append(first, len(k))))
            hit = own[o][owner > smallest]
            low[hit] = np.where(low[hit] < 0, j, low[hit])
            high[hit] = j
            if piece:
                for i in own[o][owner == smallest].tolist():
                    string = padded[left_width + at[i] - j : left_width + at[i] - j + length].tobytes()
                    begin = int(place[i]) - j
                    rows.append((int(did[i]), _name(keys, i), struct.pack("<qq", begin, begin + length), hashlib.blake2b(string, digest_size=16).digest()))
        hit = np.flatnonzero(high >= 0)
        order, groups = _by(did[hit], None if keys is None else keys[hit])
        for i, x, y in groups:
            o = hit[order[x:y]]
            rows.append((int(did[hit[i]]), _name(keys, hit[i]), np.stack([place[o] - high[o], place[o] - low[o] + length], axis=1).tobytes(), None))
        return pa.Table.from_batches([_batch(rows, _MATCHED)])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(did, key, text): key is empty where no other row has the doc_id, else the SHA-256 of the text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.col("text").cast("string").alias("text"))
    several = cut(rows.groupBy("did").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("did") != NULL_ID)).select("did", F.lit(True).alias("several")))
    digest, none = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), F.expr("X''")
    if several.limit(1).count():
        rows = rows.join(several, "did", "left")
        return rows.select("did", F.when(F.col("several") | (F.col("did") == NULL_ID), digest).otherwise(none).alias("key"), "text")
    return rows.select("did", F.when(F.col("did") == NULL_ID, digest).otherwise(none).alias("key"), "text")


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(did, key, text) of all documents, and (did, key, spans): packed pairs of start and end, some of them overlapping."""
    spark = docs.sparkSession
    rows = keyed(docs)
    buckets = BUCKETS * partitions(spark)
    prints = rows.mapInArrow(_print_blocks(buckets, length, gram), "bucket int, ids binary, keys binary, times binary, prints binary")
    repeated = prints.groupBy("bucket").applyInArrow(_repeated(hot), "did long, key binary, prints binary").groupBy("did", "key").agg(F.collect_list("prints").alias("prints"))
    sent = spark.sparkContext.broadcast(splitters(rows, buckets, length, gram))
    both = rows.join(repeated, ["did", "key"], "left").select("did", "key", "text", "prints")
    suffixes = both.mapInArrow(_suffix_blocks(sent, buckets, length, gram), "bucket long, did binary, keys binary, place binary, most binary, least binary, context binary")
    # the texts are shuffled a second time for the result; what was shuffled for the matches goes first
    matched = freed(suffixes.groupBy("bucket").applyInArrow(_match(length, gram), "did long, key binary, spans binary, digest binary"))
    still_open = matched.where("digest is not null")
    first = still_open.groupBy("digest").agg(F.min("did").alias("first"))
    across = still_open.join(first, "digest").where("did > first").select("did", "key", "spans")
    spans = matched.where("digest is null").select("did", "key", "spans").union(across)
    return rows, spans.groupBy("did", "key").agg(F.collect_list("spans").alias("spans"))


def _cut_out(batches):
    for batch, bodies in t.slices(batches):
        out: list = [[], [], [], []]
        for body, lists in zip(bodies, batch.column(2).to_pylist()):
            gone, runs, rest = 0, 0, body
            if lists:
                spans = np.frombuffer(b"".join(lists), np.int64).reshape(-1, 2)
                step = np.zeros(len(body) + 1, np.int32)
                np.add.at(step, spans[:, 0], 1)
                np.add.at(step, spans[:, 1], -1)
                cover = np.cumsum(step[:-1]) > 0
                gone = int(cover.sum())
                runs = int((np.diff(cover.view(np.int8), prepend=np.int8(0)) == 1).sum())
                rest = np.frombuffer(body, np.uint8)[~cover].tobytes()
            for x, y in zip(out, (len(body), gone, runs, rest)):
                x.append(y)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array([hashlib.sha256(x).hexdigest() for x in out[3]], pa.string())], names=["did", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    rows, spans = removed(docs, length, gram, hot)
    out = rows.join(spans, ["did", "key"], "left").select("did", "text", "spans").mapInArrow(_cut_out, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.nullif("did", F.lit(NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


#: The same by all 50-byte strings, as hexadecimal text.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY 1),
h AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.s = f.s WHERE g.doc_id > first),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY 1, 2),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM r),
k AS (SELECT p.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS head FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
