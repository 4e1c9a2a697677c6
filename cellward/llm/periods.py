r"""Periodic run detection over the words of each text.

Words are ``[^\x20\x09-\x0D]+``, numbered from 0.  A run is a stretch of words with smallest period q and length of at
least ``max(LEAST, 2 * q)`` that no neighbouring word extends with that period.

Every run has a Lyndon root: under one of the two orders of the words (as numbered, or reversed) some place in it is
where a longest Lyndon word of length q starts.  Those words come from a stack scanned from right to left, which compares
suffixes by their longest common extension: a few words directly, then doubling and binary search over a rolling hash
of the words, and the found stretch again word by word.  Each Lyndon word is then extended to both sides in the same
way, and what is long enough is a run; it is compared word by word before it is believed.  There is no suffix array.

A null text has no words, a text without words no runs; both have the digests of empty strings.  Repeated rows are
worked on one by one, each by its own doc_id; a null doc_id stands for the empty number.  Other columns are never
looked at.  A text is worked on whole, with memory in proportion to its words and never to the partition.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm import textops as t
from cellward.llm.sparkops import table, texts

LEAST = 12
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words that a comparison looks at before it asks the hash.
DIRECT = 8


class Sequence:
    """Numbers of words, one text after the other, with hashes of any stretch."""

    def __init__(self, ids: np.ndarray):
        up, self.down = t.powers(len(ids) + 1)
        self.ids = ids
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(t.mix(ids.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def same(self, i, j, length):
        """Whether the stretches of that length from i and from j are equal by their hashes."""
        return (self.sums[i + length] - self.sums[i]) * self.down[i] == (self.sums[j + length] - self.sums[j]) * self.down[j]

    def extend(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """For each i < j the number of equal words from there on, or before there, up to ``most``."""
        length = np.zeros(len(i), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            longer = length + step
            ok = np.flatnonzero(longer <= most)
            a, b, n = i[ok], j[ok], longer[ok]
            if back:
                a, b = a - n, b - n
            ok = ok[self.same(a, b, n)]
            length[ok] += step
            step >>= 1
        return length


class Comparer:
    """Longest common extensions of two places of one text (from ``first`` up to ``end``), asked one by one."""

    def __init__(self, seq: Sequence, words: list[int], first: int, end: int):
        self.seq, self.words, self.first, self.n = seq, words, first, end - first
        self.known: dict[int, tuple[int, int]] = {}  # by distance d: places [a, b) with words[x] == words[x + d], and not at b

    def extension(self, i: int, j: int) -> int:
        """Equal words from i and j > i on, of which the first are known to be equal."""
        words, n = self.words, self.n
        stop = min(n - j, DIRECT)
        length = 1
        while length < stop and words[i + length] == words[j + length]:
            length += 1
        if length < stop or length == n - j:
            return length
        a, b = self.known.get(j - i, (n, n))
        if a <= i + length <= b:
            self.known[j - i] = min(a, i), b
            return b - i
        length = self.verified(i, j, self.searched(i, j, length))
        self.known[j - i] = i, i + length
        return length

    def searched(self, i: int, j: int, length: int) -> int:
        """Doubling, then binary search over the hashes."""
        i, j, most = i + self.first, j + self.first, self.n - j
        low, high = length, min(2 * length, most)
        while low < high and self.seq.same(i, j, high):
            low, high = high, min(2 * high, most)
        while high - low > 1:
            middle = (low + high) // 2
            if self.seq.same(i, j, middle):
                low = middle
            else:
                high = middle
        return low

    def verified(self, i: int, j: int, length: int) -> int:
        """The length as far as the words themselves are equal."""
        x, y = (self.seq.ids[p + self.first : p + self.first + length] for p in (i, j))
        differ = np.flatnonzero(x != y)
        return int(differ[0]) if len(differ) else length


def lyndon_ends(words: list[int], compare: Comparer) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there, where the end of the text is smaller than any word."""
    n = len(words)
    ends, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        own = words[i]
        while stack:
            j = stack[-1]
            other = words[j]
            if own < other:
                stack.pop()
                continue
            if own > other:
                break
            length = compare.extension(i, j)
            if j + length == n or words[i + length] > words[j + length]:
                break
            stack.pop()
        if stack:
            ends[i] = stack[-1]
        stack.append(i)
    return ends


def _grown(ids: np.ndarray, root: int, period: int, first: int, end: int) -> tuple[int, int]:
    """Start and length of the stretch with that period around a root, word by word."""
    a, b = root, root + period
    while b < end and ids[b] == ids[b - period]:
        b += 1
    while a > first and ids[a - 1] == ids[a - 1 + period]:
        a -= 1
    return a, b - a


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Of each text (from ``first[k]`` up to ``first[k + 1]``) its runs (start in the text, length, period), sorted by start and period."""
    seq = Sequence(ids)
    starts, ends = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a < least:
            continue
        part = ids[a:b]
        words, turned = part.tolist(), (-part).tolist()
        with np.errstate(over="ignore"):
            for order in (words, turned):
                starts.append(np.arange(a, b))
                ends.append(np.array(lyndon_ends(order, Comparer(seq, order, a, b)), np.int64) + a)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    if not starts:
        return out
    i, j = np.concatenate(starts), np.concatenate(ends)
    text = np.searchsorted(first, i, "right") - 1
    low, high = first[text], first[text + 1]
    after = (j < high) & (ids[i] == ids[np.minimum(j, len(ids) - 1)])
    before = (i > low) & (ids[np.maximum(i - 1, 0)] == ids[j - 1])
    some = np.flatnonzero(after | before)
    i, j, text, low, high = i[some], j[some], text[some], low[some], high[some]
    left = seq.extend(i, j, i - low, back=True)
    length = left + (j - i) + seq.extend(i, j, high - j)
    some = np.flatnonzero(length >= np.maximum(least, 2 * (j - i)))
    found = np.stack([text[some], i[some] - left[some], j[some] - i[some], length[some], i[some]], 1)
    keys, group = np.unique(found[:, :4], axis=0, return_inverse=True)
    for g, (k, start, period, size) in enumerate(keys.tolist()):
        a, b = int(first[k]), int(first[k + 1])
        stretches = [(start, size)]
        if not np.array_equal(ids[start : start + size - period], ids[start + period : start + size]):  # the hashes were wrong
            stretches = [_grown(ids, root, period, a, b) for root in found[group == g, 4].tolist()]
        out[k] += [(s - a, n, period) for s, n in stretches if n >= max(least, 2 * period)]
    return [sorted(set(runs), key=lambda r: (r[0], r[2])) for runs in out]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the period that the contract plants by the doc_id's checksum, in a tenth of the texts."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole = words[a : a + p]
    return words[:a] + (whole * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without the repetitions: of every run only the first period stays."""
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            step[start + period] += 1
            step[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
    return b" ".join(words)


def _run(least: int, plant: bool):
    def run(batches):
        for batch, bodies in t.slices(batches):
            ids = batch.column(0)
            words = [WORD.findall(body) for body in bodies]
            if plant:
                words = [planted(k, own) for k, own in zip(ids.to_pylist(), words)]
            first = np.cumsum([0, *map(len, words)])
            numbers = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = find_runs(numbers, first, least)
            kept = [collapsed(own, found) for own, found in zip(words, runs)]
            spans = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, plant: bool = False) -> DataFrame:
    """doc_id, all runs by start and period, and the words left without their repetitions, joined by one space.

    ``plant`` first writes a period into a tenth of the texts, chosen by doc_id.
    """
    return texts(docs).mapInArrow(_run(least, plant), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
