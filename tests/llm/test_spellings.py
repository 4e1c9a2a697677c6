"""Spelling variants against a plain comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from cellward.llm import spellings
from cellward.llm.sparkops import table


def near(x, y):
    """One edit apart, by the edits themselves."""
    if x == y:
        return False
    gone = lambda s: {s[:i] + s[i + 1 :] for i in range(len(s))}
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return x in gone(y) or y in gone(x)


def brute_words(docs, damage=199):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def brute(words):
    pairs = {w: [] for w in words}
    keys = sorted(words)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            if abs(len(x) - len(y)) <= 1 and near(x, y):
                pairs[x].append(y)
                pairs[y].append(x)
    form = {}
    for w, others in pairs.items():
        best = min(others, key=lambda y: (-words[y], y), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(pairs[w]), words[form[w]] if form[w] else None))
    return out


def invented(seed, n, letters="abeé"):
    draw, words = random.Random(seed), {}
    for _ in range(n):
        w = "".join(draw.choice(letters) for _ in range(draw.randrange(4, 12)))
        words[w] = draw.choice([5, 6, 25, 30, 125, 700])
        for _ in range(3):
            i = draw.randrange(len(w))
            words[draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]])] = draw.choice([5, 5, 9, 30])
    return words


def test_one_edit():
    draw = random.Random(1)
    for _ in range(20_000):
        x, y = ("".join(draw.choice("ab") for _ in range(draw.randrange(6))) for _ in range(2))
        assert spellings.one_edit(x, y) == near(x, y), (x, y)


@pytest.mark.parametrize(("q", "block"), [(2, 1024), (2, 7), (3, 50)])
def test_all_pairs_are_found(spark, q, block):
    words = {w: n for w, n in invented(q + block, 250).items() if len(w) >= 2 * q + 1}
    words |= dict.fromkeys(["a" * k for k in range(7, 12)] + ["ab" * k for k in range(4, 7)] + ["b" + "a" * k for k in range(6, 9)], 5)
    got = spellings.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), q, block).collect()
    want = {(x, words[x], y, words[y]) for x in words for y in words if x < y and near(x, y)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_forms_and_roots_with_ties(spark):
    words = invented(9, 200) | {"tokens": 5, "tokenz": 25, "tokena": 25, "tokenzz": 125, "tokenzzy": 700, "tokenzzyx": 3600, "zebras": 7}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    got = {tuple(r) for r in spellings.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == brute(words)
    assert next(r for r in got if r[0] == "tokens")[1] == "tokena"  # the smaller of two with the same count


def test_query_by_definition(spark, tmp_path):
    draw = random.Random(4)
    words = list(invented(6, 60)) + ["Straße", "STRASSE", "über×los", "x" * 70, "café" * 30, "Ünïcode", "naïveté"]
    docs = [(k, " ".join(draw.choice(words) + draw.choice(["", "", "ā", "×", "'s", "1", "中"]) for _ in range(200)), "n") for k in range(150)]
    docs += [(7, docs[0][1], None), (None, docs[1][1], ""), (900, None, "x"), (901, "", "word"), (902, "é" * 5000 + " " + "wordlike " * 40, "")]
    spark.createDataFrame(docs, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = spellings.op11_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(brute_words([d[:2] for d in docs]))
    assert {tuple(r) for r in got.collect()} == want and any(r[1] for r in want)


def test_query_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    rows = spellings.op11_spelling_variants(spark, folder).collect()
    assert {tuple(r) for r in rows} == brute(brute_words(docs)) and len(rows) == len(set(rows))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n int")
    assert spellings.variants(spellings.vocabulary(docs)).count() == 0
    one = spark.createDataFrame([(1, None), (None, ""), (2, "words " * 5)], "doc_id long, text string")
    assert [tuple(r) for r in spellings.variants(spellings.vocabulary(one, letters=5)).collect()] == [("words", None, "words", 5, 0, None)]
