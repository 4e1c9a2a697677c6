import gc
import random
import re
import weakref
from collections import Counter

import numpy as np
import pytest

from cellward.llm import quality
from cellward.llm.bpe import vocabulary
from cellward.llm.tokens import codec


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


TEXTS = ["", " \n ", "a b c a b c a", "é\x00ü #x|\n\n a\t\n\x0b a\t\n a", "x " * 60, "one two three\none two three\none two three", "\x00 \x00", "日本 語 & <b>", "a\n", "\na\na"]


def test_counts():
    got = quality.features([x.encode() for x in TEXTS])
    for i, x in enumerate(TEXTS):
        assert tuple(int(got[c][i]) for c in quality.FEATURES) == brute(x), x


def plain_log_perplexity(corpus, judged, discounts):
    """Of the judged text under the other texts of the corpus, by the definition; discounts[order] are given."""
    n, marks = quality.ORDER, "\0" * (quality.ORDER - 1)
    counts = Counter(x[i : i + n] for x in (marks + y for y in corpus) for i in range(len(x) - n + 1))
    levels = {n: counts}
    for order in range(n - 1, 0, -1):
        levels[order] = Counter(g[1:] for g in levels[order + 1])

    def p(context, c):
        order = len(context) + 1
        level = levels[order]
        lower = p(context[1:], c) if context else 1 / (1 << quality.BITS)
        following = {g: k for g, k in level.items() if g[:-1] == context}
        if not following:
            return lower
        d, total = discounts[order], sum(following.values())
        k = following.get(context + c, 0)
        return (k - d[min(k, 3)]) / total + sum(d[min(x, 3)] for x in following.values()) / total * lower

    whole = marks + judged
    values = [-np.log(p(whole[i : i + n - 1], whole[i + n - 1])) for i in range(len(judged))]
    parts = [values[a : a + quality.SEGMENT] for a in range(0, max(1, len(values) // quality.SEGMENT) * quality.SEGMENT, quality.SEGMENT)]
    parts[-1] = values[(len(parts) - 1) * quality.SEGMENT :]
    return float(np.median([np.mean(x) for x in parts])) if values else 0.0


def counts_of_counts(corpus):
    n, marks = quality.ORDER, "\0" * (quality.ORDER - 1)
    level, out = Counter(x[i : i + n] for x in (marks + y for y in corpus) for i in range(len(x) - n + 1)), {}
    for order in range(n, 0, -1):
        out[order] = quality.discounts([sum(v == i for v in level.values()) for i in (1, 2, 3, 4)])
        level = Counter(g[1:] for g in level)
    return out


def test_discounts():
    assert quality.discounts([100, 40, 20, 10]) == pytest.approx([0, 1 - 2 * (100 / 180) * 0.4, 2 - 3 * (100 / 180) * 0.5, 3 - 4 * (100 / 180) * 0.5])
    assert quality.discounts([0, 0, 0, 0]) == pytest.approx([0, 0.5, 1.0, 1.5])


@pytest.mark.parametrize("part", [quality.PART, 40])
def test_perplexity_without_the_texts_own_counts(spark, part):
    rng = random.Random(8)
    text = lambda k: "".join(rng.choice("abcde  \u00e9\u0436") for _ in range(k))
    en, fr = [text(60) for _ in range(4)] + [text(199), text(200), text(430)] + ["", "a", "abcabcabc"], [text(40) for _ in range(3)] + ["zz\u4e2d\u6587 zz"]
    alone, nothing = [text(30)], [text(20)]
    rows = [(x, lang) for lang, xs in (("en", en), ("fr", fr), ("rare", alone), (None, nothing)) for x in xs]
    folder = quality.train(spark.createDataFrame(rows, "text string, lang string"), part)
    models, everything = quality.Models(folder), [x for x, _ in rows]
    mixed = dict(zip(everything, quality.Scorer(models, [x.encode() for x in everything]).score([f"x{lang.encode().hex().upper()}" if lang else "null" for _, lang in rows])))
    hashed = {c: chr(1 + int(quality.t.mix(np.array([ord(c)], np.uint64))[0] % np.uint64((1 << quality.BITS) - 1))) for c in "\u4e2d\u6587"}
    known = lambda xs: ["".join(hashed.get(c, c) for c in x) for x in xs]
    for key, texts in (("x656E", en), ("x6672", fr), ("x72617265", alone), ("null", nothing), (quality.ALL, everything)):
        got = quality.Scorer(models, [x.encode() for x in texts]).score(key)
        if key != quality.ALL:
            assert got.tolist() == pytest.approx([mixed[x] for x in texts], rel=1e-12)
        plain = known(texts)
        d = counts_of_counts(plain)
        for i, x in enumerate(plain):
            assert got[i] == pytest.approx(plain_log_perplexity(plain[:i] + plain[i + 1 :], x, d), rel=1e-9), (key, i)
    assert quality.Scorer(models, [b"ab"]).score("x00")[0] == pytest.approx(np.log(1 << quality.BITS))  # a language without a model


def test_small_languages_and_nulls_stay(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("thean orins".replace(" ", "")) for _ in range(5)) for _ in range(300)]
    prose = lambda letters=None: " ".join((rng.choice(words) if letters is None else "".join(rng.choice(letters) for _ in range(5))) for _ in range(120))
    rows = [(i, prose(), "en") for i in range(60)] + [(100, prose("\u0436\u0434\u0430\u043e\u0442"), "ru"), (101, prose(), None), (102, prose(), "xx"), (103, prose(), "xx")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got.values())


def test_clashing_columns_and_a_very_long_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("thean") for _ in range(4)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(90)), "en", "b", True, 1.5, i) for i in range(20)]
    rows.append((50, " ".join(rng.choice(words) for _ in range(300_000)), "en", None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, body string, FAILED boolean, low double, key long")
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} <= set(rows)
    assert kept.count() >= 20


def test_judgement(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("thean orins".replace(" ", "")), 5)) for _ in range(400)]
    prose = [" ".join(rng.choice(vocabulary, 120)) for _ in range(80)]
    odd = " ".join("".join(rng.choice(list("QXZJ0123456789#@~^"), 9)) for _ in range(90))
    rows = [(i, x, "en", "s") for i, x in enumerate(prose)] + [(900, odd, "en", "s"), (901, None, None, None), (None, prose[0], "en", "s"), (902, "few words", "en", "s"), (0, prose[0], "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, slot string")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    kept = sorted((r.doc_id for r in got if r.kept), key=str)
    assert kept == sorted([*range(80), 0, None], key=str)
    again = quality.keep(docs)
    assert again.columns == docs.columns
    assert sorted((r.doc_id for r in again.collect()), key=str) == kept
    assert quality.judge(docs.where("doc_id < -1")).count() == 0
    assert quality.keep(docs.where("doc_id < -1")).count() == 0


def test_a_key_in_prose_does_not_reject_it(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("thean orins".replace(" ", "")) for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(120), "en") for i in range(60)]
    rows += [(100 + i, f"{prose(60)} {''.join(rng.choice('0123456789abcdefXYZ+/') for _ in range(60))} {prose(60)}", "en") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got.values())


def test_a_worker_holds_a_codec_or_models(spark):
    """Never both: workers live on from stage to stage, and what each stage left would add up in an executor."""
    docs = spark.createDataFrame([(i, f"some words of document {i} " * 9, "en") for i in range(9)], "doc_id long, text string, lang string")
    path, folders, bodies = vocabulary("word_bpe_49k.json"), [quality.train(docs) for _ in range(2)], [b"some words of document 3 " * 9]
    old = weakref.ref(codec(path))
    assert codec(path) is old()
    want = quality._judged(folders[0], bodies, [quality.ALL])[2:]
    gc.collect()
    assert old() is None
    models = weakref.ref(quality._models(folders[0]))
    assert models() is quality._models(folders[0]) and models().parts
    assert quality._judged(folders[1], bodies, [quality.ALL])[2:] == want
    gc.collect()
    assert models() is None
    models = weakref.ref(quality._models(folders[1]))
    codec(path)
    gc.collect()
    assert models() is None
