import random
import re

from cellward.llm import near

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, similarity=0.8):
    sets = []
    for _, x in rows:
        w = WORD.findall((x or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    different = sorted(set(sets) - {frozenset()}, key=sorted)
    linked = {s: [o for o in different if o != s and len(s & o) >= similarity * len(s | o) - 1e-9] for s in different}
    out = []
    for (doc_id, _), s in zip(rows, sets):
        if not s:
            out.append((doc_id, doc_id, 0, 1))
            continue
        group, todo = {s}, [s]
        while todo:
            for o in linked[todo.pop()]:
                if o not in group:
                    group.add(o)
                    todo.append(o)
        ids = [i for (i, _), x in zip(rows, sets) if x in group]
        out.append((doc_id, min((i for i in ids if i is not None), default=None), len(linked[s]), sets.count(s)))
    return out


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("thean orins".replace(" ", "")) for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    rows = []
    for base in range(8):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 140))]
        for _ in range(12 if base else 40):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(i, x) for i, x in enumerate(rows)] + [(500, None), (501, ""), (502, "!!"), (503, "a b"), (504, "A, b."), (None, rows[0]), (None, "only null here it is"), (3, rows[3]), (3, "other text of the same id here")]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cid int")
    want = sorted(brute(rows), key=repr)
    for small, block in ((32, 256), (2, 5)):
        got = near.groups(docs, small=small, block=block).select("doc_id", "class_id", "n_links", "n_copies").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_one_of_each_group_stays(spark):
    rows = corpus(8)
    docs = spark.createDataFrame([(*r, "de") for r in rows], "doc_id long, text string, lang string")
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    judged = brute(rows)
    want = {c for _, c, _, _ in judged if c is not None}
    assert {x for x in got if x is not None} >= want and len(got) <= len({(c, i is None and c is None) for i, c, _, _ in judged}) + 1


def test_one_stays_of_near_copies_that_share_an_id(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:k], "changed", *words[k + 1 :]])) for i, k in ((None, 3), (None, 40), (7, 50), (7, 60), (8, 70))]
    other = [(None, " ".join(f"v{j}" for j in range(60))), (7, " ".join(f"u{j}" for j in range(60)))]
    keep = lambda r: sorted(near.keep_first(spark.createDataFrame(r, "doc_id long, text string")).collect(), key=repr)
    assert [r.doc_id for r in keep(rows)] == [7]
    assert [r.doc_id for r in keep(rows[:2])] == [None]
    assert sorted(r.text[0] for r in keep([*rows, *other])) == ["u", "v", "w"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.groups(docs).count() == 0 and near.keep_first(docs).count() == 0


def test_plan():
    bands, rows = near.plan()
    assert 1 - (1 - 0.8**rows) ** bands >= near.RECALL and bands * rows <= near.HASHES


def test_ties_clashing_columns_and_a_very_long_text(spark):
    words = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"x{i % 5000}" for i in range(200_000))
    rows = [(1, words, 2, "b", None), (1, words, 1, "b", "z"), (1, words.upper(), 0, "b", "z"), (2, words + " more", 5, "b", "z"), (3, long, 1, None, None), (4, None, 1, None, None), (4, None, 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cid int, body string, ID string")
    want = sorted([(1, words.upper(), 0, "b", "z"), rows[4], rows[5], rows[6]], key=repr)
    assert sorted(map(tuple, near.keep_first(docs).collect()), key=repr) == want
    docs = docs.repartition(5)
    assert sorted(map(tuple, near.keep_first(docs).collect()), key=repr) == want


def test_texts_of_one_template_and_of_one_id(spark):
    rng = random.Random(3)
    template = [f"t{i}" for i in range(60)]
    own = lambda: [f"u{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(None if i % 2 else 5, " ".join(template + own())) for i in range(120)]
    rows += [(i, " ".join(template + own()[:4])) for i in range(1000, 1040)]
    got = near.groups(spark.createDataFrame(rows, "doc_id long, text string"), small=2, block=7).select("doc_id", "class_id", "n_links", "n_copies").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute(rows), key=repr)
