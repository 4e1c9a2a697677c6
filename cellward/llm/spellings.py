r"""Spelling variants: words one edit apart, found with a positional q-gram index.

Words are maximal runs ``[A-Za-zÀ-ÿ]+``, of which A-Z are lower-cased.  Those of at least LETTERS code points
that occur at least OCCURRENCES times are the vocabulary.  Two words are near if exactly one inserted, deleted or
replaced code point makes one of the other.

One edit destroys at most q of a word's q-grams, so near words share at least ``longer - q + 1 - q`` of them, in the
same place or, if one word is longer, one place on.  Ordered from the rarest gram on, at least two shared grams are among
the first q + 2 of both words.  So every word is sent to the posting lists of the pairs of its first q + 2 grams only
(under the shorter length of a pair of words, and the places that the grams may have there).  Within such a list an
inverted index of (length, gram, place) over all grams is built; for each word the postings that length and place allow
are merged with a heap, and what comes up often enough is compared letter by letter.  A list of more than BLOCK words is
dealt out in blocks, and every pair of blocks is work of its own.

A word's form is its near word of largest count (the smallest in code-point order among equals), if that count is at
least RATIO times its own; its root is where the forms end.  Counts grow with each form, so there are no cycles.

Null and empty texts have no words.  Repeated rows count as often as they stand there; a null doc_id stands for the
empty number.  Other columns are never looked at.  An empty vocabulary gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm import textops as t
from cellward.llm.sparkops import by_group, cut, dealt, table, texts

LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: Of runs whose checksum this number divides, one code point is deleted.
DAMAGE = 199
#: Letters of a gram.  Words need more than twice as many, or near words might share fewer than two grams.
Q = 2
BLOCK = 1024
#: Most grams that are ordered by their frequency; all others count as rarer and go by code points.
RANKED = 1 << 16


def _letters() -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    lut[0x41:0x5B] = np.arange(0x61, 0x7B)
    lut[0x61:0x7B] = np.arange(0x61, 0x7B)
    return lut


def _crc_table() -> np.ndarray:
    at = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        at = np.where(at & 1, (at >> 1) ^ np.uint32(0xEDB88320), at >> 1).astype(np.uint32)
    return at


LOWER, CRC = _letters(), _crc_table()
#: Longer runs are summed one by one.
LONG = 64


def runs_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all runs one after the other, each run's end there, its number of code points, and its text."""
    raw, _, ends = t.joined(bodies)
    # U+00C0 to U+00FF are C3 and one more byte in UTF-8, and nothing else has a C3
    lead = raw == 0xC3
    tail = np.zeros(len(raw), bool)
    tail[1:] = lead[:-1]
    low = LOWER[raw]
    inside = (low != 0) | lead | tail
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = stop - start
    letters = np.where(low != 0, low, raw)[inside]
    until = np.cumsum(size)
    points = np.cumsum(np.append(0, tail[inside]))
    return letters, until, size - (points[until] - points[until - size]), np.searchsorted(ends, start, "right")


def checksums(letters: np.ndarray, until: np.ndarray, text: np.ndarray, prefixes: list[bytes]) -> np.ndarray:
    """crc32 of each run behind the prefix of its text."""
    size = np.diff(until, prepend=0)
    begin = until - size
    state = np.array([zlib.crc32(p) for p in prefixes], np.uint32)[text] ^ np.uint32(0xFFFFFFFF)
    active = np.flatnonzero(size <= LONG)
    k = 0
    while len(active):
        byte = letters[begin[active] + k]
        state[active] = CRC[(state[active] ^ byte) & np.uint32(0xFF)] ^ (state[active] >> np.uint32(8))
        k += 1
        active = active[size[active] > k]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        state[i] = zlib.crc32(letters[begin[i] : until[i]].tobytes(), zlib.crc32(prefixes[text[i]]))
    return state


def _count(least: int, damage: int | None):
    def run(batches):
        for batch, bodies in t.slices(batches):
            letters, until, points, text = runs_of(bodies)
            changed, kept = [], points >= least
            if damage:
                prefixes = [b":" if k is None else b"%d:" % k for k in batch.column(0).to_pylist()]
                sums = checksums(letters, until, text, prefixes)
                hit = (sums % np.uint32(damage) == 0) & (points > least)
                for i, h in zip(np.flatnonzero(hit).tolist(), sums[hit].tolist()):
                    word = letters[until[i - 1] if i else 0 : until[i]].tobytes().decode()
                    at = h % len(word)
                    changed.append(word[:at] + word[at + 1 :])
                kept &= sums % np.uint32(damage) != 0
            offsets = pa.py_buffer(np.append(0, until).astype(np.int64))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(until), [None, offsets, pa.py_buffer(letters)])
            words = pa.concat_arrays([words.filter(pa.array(kept)).cast(pa.binary()), pa.array([w.encode() for w in changed], pa.binary())])
            found = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1).cast(pa.int64())], names=["word", "n"])

    return run


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, damage: int | None = None) -> DataFrame:
    """(word, n) of all words that are long and frequent enough; ``damage`` first deletes code points by checksum."""
    counted = texts(docs).mapInArrow(_count(letters, damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def grams(word: str, q: int) -> list[str]:
    return [word[i : i + q] for i in range(len(word) - q + 1)]


def _keys(q: int, rank: dict[str, int]):
    """Of each word the posting lists in which it can meet near ones: (length of the shorter word, hash of two grams and their places in it)."""

    def run(batches):
        for batch in batches:
            at, sizes, keys = [], [], []
            for k, word in enumerate(batch.column(0).to_pylist()):
                own = sorted((rank.get(g, 0), g, i) for i, g in enumerate(grams(word, q)))[: q + 2]
                n = len(word)
                for (_, g, i), (_, h, j) in combinations(sorted(own, key=lambda x: x[2]), 2):
                    # as the shorter or an equally long word, then as the longer one, before or after its additional letter
                    for size, x, y in ((n, i, j), (n - 1, i, j), (n - 1, i, j - 1), (n - 1, i - 1, j - 1)):
                        if 0 <= x < y <= size - q:
                            at.append(k)
                            sizes.append(size)
                            keys.append(f"{g}{x},{h}{y}")
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.string())], names=["word", "n", "size", "grams"])

    return run


def one_edit(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes y of x."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return x[k + (len(x) >= len(y)) :] == y[k + (len(y) >= len(x)) :]


def merged(lists: list[list[int]], least: int):
    """What occurs in the sorted lists at least so often, by a heap over all of them."""
    last, times = None, 0
    for item in heapq.merge(*lists):
        times = times + 1 if item == last else 1
        last = item
        if times == least:
            yield item


def near_within(probes: list[tuple[int, str]], indexed: list[tuple[int, str]], size: int, q: int):
    """(i, j) of near words of the two lists, of which the shorter word has that size; i < j where both are of one list."""
    postings: dict[tuple[int, str, int], list[int]] = defaultdict(list)
    of_size: dict[int, list[int]] = defaultdict(list)
    word = dict(indexed)
    for k, w in indexed:
        of_size[len(w)].append(k)
        for i, g in enumerate(grams(w, q)):
            postings[len(w), g, i].append(k)
    for k, w in probes:
        own = grams(w, q)
        # two longer words meet under their own length; the longer one's gram stands where the shorter one's does, or one place on
        for other, shifts in ((size, (0,)), (size + 1, (0, 1))) if len(w) == size else ((size, (0, -1)),):
            everyone = of_size[other]
            lists = [found for i, g in enumerate(own) for d in shifts if (found := postings.get((other, g, i + d)))]
            some = [found for found in lists if len(found) < len(everyone)]
            least = max(len(w), other) - q + 1 - q - (len(lists) - len(some))  # what all words have needn't be merged
            if len(some) < least:
                continue
            for j in everyone if least <= 0 else set().union(*some) if least == 1 else merged(some, least):
                if (probes is not indexed or k < j) and one_edit(w, word[j]):
                    yield k, j


def _near(q: int):
    def run(batch: pa.RecordBatch, bounds: list[int]):
        words, sizes, blocks, i, j = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("word", "size", "block", "i", "j"))
        left, right = [], []
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2:
                continue
            own = [(k, words[k]) for k in range(a, b) if blocks[k] == i[a]]
            others = own if i[a] == j[a] else [(k, words[k]) for k in range(a, b) if blocks[k] == j[a]]
            for x, y in near_within(own, others, sizes[a], q):
                left.append(x)
                right.append(y)
        one, other = batch.take(pa.array(left, pa.int64())), batch.take(pa.array(right, pa.int64()))
        at = [batch.schema.get_field_index(c) for c in ("word", "n")]
        yield pa.RecordBatch.from_arrays([*(one.column(k) for k in at), *(other.column(k) for k in at)], names=["a", "na", "b", "nb"])

    return run


def near_words(words: DataFrame, q: int = Q, block: int = BLOCK) -> DataFrame:
    """Of a vocabulary (word, n) all pairs (a, na, b, nb) of near words, a < b.

    Words of fewer than 2 * q + 1 code points are refused.
    """
    words = cut(words.select("word", "n"))
    if words.where(F.length("word") <= 2 * q).limit(1).count():
        raise ValueError(f"grams of {q} letters need words of at least {2 * q + 1}")
    listed = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - (q - 1)), lambda i: F.substring("word", i, F.lit(q)))).alias("gram"))
    often = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "gram").limit(RANKED).collect()
    rank = {row.gram: k for k, row in enumerate(reversed(often), 1)}
    rows = words.mapInArrow(_keys(q, rank), "word string, n long, size int, grams string")
    pairs = by_group(dealt(rows, ["size", "grams"], "word", block), ["size", "grams", "i", "j"], _near(q), "a string, na long, b string, nb long")
    one, other = (F.struct(F.col(w).alias("w"), F.col(n).alias("n")) for w, n in (("a", "na"), ("b", "nb")))
    pairs = pairs.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).distinct()
    return pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("na"), F.col("y.w").alias("b"), F.col("y.n").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): of (word, form), where each word has one form at most, the last that the forms lead to."""
    ways = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = cut(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not ways.where("moved").limit(1).count():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variants(words: DataFrame, q: int = Q, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """Of a vocabulary (word, n): word, form, root, n, n_near, form_n, as the module says."""
    words = cut(words)
    pairs = cut(near_words(words, q, block))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("strong", -F.col("best.m") >= ratio * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("strong"), F.col("best.near")).alias("form"), F.when(F.col("strong"), -F.col("best.m")).alias("form_n"))
    found = cut(found)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), damage=DAMAGE))
