import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pytest

from cellward.llm import repeats


def brute(rows, length):
    ids = [i if i is not None else 1 << 63 for i, _ in rows]
    bodies = [(x or "").encode() for _, x in rows]
    smallest = {}
    for i, b in zip(ids, bodies):
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            smallest[s] = min(i, smallest.get(s, i))
    out = []
    for (doc_id, _), i, b in zip(rows, ids, bodies):
        cover = [False] * len(b)
        for p in range(len(b) - length + 1):
            if smallest[b[p : p + length]] < i:
                cover[p : p + length] = [True] * length
        runs = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out.append((doc_id, len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aehnoté") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(5)] + ["ab" * 60, "\x00" * 70, "x" * 130, "é" * 40]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 12))) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts.insert(rng.randrange(3), p[a : a + rng.randrange(30, 120)])
        rows.append((i, "".join(parts)))
    rng.shuffle(rows)
    return [*rows, (70, rows[0][1]), (71, None), (72, ""), (None, rows[1][1]), (None, passages[0] * 2), (70, passages[1] + "!"), (5, passages[2]), (5, passages[2]), (80, passages[0][:50]), (81, passages[0][:49]), (-3, passages[3])]


def test_sorts():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (500, 50)).astype(np.uint8)
    rows[:, 10:] //= 2
    order = repeats.multikey_sort(rows)
    got = [r.tobytes() for r in rows[order]]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(500))


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, did int")
    got = repeats.deduplicate(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute(rows, 50), key=repr)


def check(spark, rows, **more):
    got = repeats.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute(rows, 50), key=repr)
    return got


@pytest.mark.parametrize("doc_id", [None, 7])
def test_a_thousand_rows_of_one_id(spark, doc_id):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdef ") for _ in range(80))
    rows = [(doc_id, "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(0, 90))) + shared[rng.randrange(0, 20) :]) for _ in range(1000)]
    got = check(spark, [*rows, (3, f"-{shared}-")])
    assert sum(r.n_removed > 0 for r in got) > 900


def test_a_line_of_every_document_is_dealt_to_pieces(spark):
    rng = random.Random(6)
    line = "this very line stands in every single document of the whole table, whatever else is in it\n"
    rows = [(i, "".join(rng.choice("pqrstu \n") for _ in range(rng.randrange(0, 60))) + line * rng.randrange(1, 3) + rng.choice(["", "tail " * 20])) for i in range(400)]
    rng.shuffle(rows)
    check(spark, [*rows, (None, line), (None, line * 2), (5, line)], hot=16)


def test_very_long_texts_of_one_gram(spark):
    rows = [(1, "x" * 3000), (2, "y" + "x" * 200_000), (3, "x" * 49), (4, "x" * 50)]
    got = {r.doc_id: r for r in repeats.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3, 4)] == [(0, 0), (200_000, 1), (0, 0), (50, 1)]


def test_empty(spark):
    assert repeats.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shuffled_texts_are_gone_before_they_are_shuffled_again(spark):
    """The driver's garbage isn't collected here, and yet what the matches took is off the disk when they are known."""
    folder, name = Path(spark.conf.get("spark.local.dir")), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    size = lambda: sum(f.stat().st_size for f in folder.rglob("shuffle_*.data"))
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdefghijklmnop") for _ in range(4000)) + "the same end of all texts " * 9) for i in range(300)]
    before, setting = size(), spark.conf.get(name)
    _, spans = repeats.removed(spark.createDataFrame(rows, "doc_id long, text string"))
    until = time.time() + 10
    while size() > before + 100_000 and time.time() < until:
        time.sleep(0.2)
    assert size() <= before + 100_000
    assert spark.conf.get(name) == setting and spans.count() == 299
