"""Runs by their definition, on random sequences and on texts with planted periods."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from cellward.llm import periods
from cellward.llm.sparkops import table


def brute(words, least=12):
    """Every maximal stretch of every period; of one stretch only the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            if words[a] != words[a + q]:
                a += 1
                continue
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b - a + q >= max(least, 2 * q):
                found.setdefault((a, b - a + q), q)
            a = b
    out = []
    for (a, length), q in found.items():  # another stretch's multiple of a smaller period isn't its smallest one
        if not any(all(words[x] == words[x + p] for x in range(a, a + length - p)) for p in range(1, q)):
            out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("least", [1, 4, 12])
def test_random_sequences(least):
    draw = random.Random(least)
    for _ in range(300):
        many = [[draw.randrange(draw.choice([1, 2, 3])) for _ in range(draw.randrange(40))] for _ in range(3)]
        for k in range(len(many)):
            if draw.random() < 0.5 and many[k]:
                many[k] = (many[k][: draw.randrange(1, 9)] * 20)[: draw.randrange(60)] + many[k]
        first = np.cumsum([0, *map(len, many)])
        got = periods.find_runs(np.array(sum(many, []), np.int64), first, least)
        assert got == [brute(words, least) for words in many]


def test_wrong_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(periods.t, "mix", lambda x: x & np.uint64(1))  # half of all words look alike now
    draw = random.Random(5)
    for _ in range(200):
        words = [draw.randrange(6) for _ in range(10)] * 3 + [draw.randrange(4) for _ in range(30)] + [1, 3] * 12
        got = periods.find_runs(np.array(words, np.int64), np.array([0, len(words)]), 4)
        assert got == [brute(words, 4)]


def test_long_texts_take_seconds():
    began = time.time()
    for words in ([7] * 60_000, [1, 2] * 30_000, list(range(300)) * 200, [k % 7 + k // 4000 for k in range(60_000)]):
        runs = periods.find_runs(np.array(words, np.int64), np.array([0, len(words)]))[0]
        assert runs
    assert time.time() - began < 60


def test_query_by_definition(spark, tmp_path):
    draw = random.Random(2)
    rows = [(k, " ".join(draw.choice(["a", "b", "über", "das"]) for _ in range(draw.randrange(120))), "x") for k in range(150)]
    rows += [(200, "\t\n " + "ab cd\r\n" * 40, None), (201, None, None), (202, "", "y"), (202, "one\x0btwo\x0cthree", "y"), (203, "x " * 500, "")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periods.op12_periodic_runs(spark, str(tmp_path))
    assert tuple(got.columns) == COLUMNS
    want = [plain(k, text) for k, text, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_query_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in periods.op12_periodic_runs(spark, folder).collect()}
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) >= len(docs) // 20
    short = [d for d in docs if len((d.text or "").split()) < 1500]
    assert {d.doc_id: got[d.doc_id] for d in short} == {d.doc_id: plain(*d) for d in short}


def test_empty_table_null_ids_and_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, words int")
    assert periods.periodic_runs(empty).count() == 0
    row = periods.periodic_runs(spark.createDataFrame([(None, "go " * 12, 1)], "doc_id long, text string, `collapsed.x` int"), plant=True).first()
    assert row.doc_id is None and row.runs == [(0, 12, 1)] and row.collapsed == "go"
