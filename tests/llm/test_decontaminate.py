import hashlib
import random
import re

from cellward.llm import decontaminate


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])] - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def tables():
    rng = random.Random(5)
    word = lambda k=6: "".join(rng.choice("abc") for _ in range(rng.randrange(1, k)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(20, "from " * 30), (21, ""), (22, None), (3, "x Y z w v"), (11, "é ü"), (None, "no id but words"), (None, "a b c a b c " * 5)]
    docs = []
    for i in range(40):
        w = [word(3) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            x = words_of(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(x) - 10))
            w[rng.randrange(len(w) + 1) : 0] = x[a : a + rng.randrange(5, 30)]
        docs.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    return [*docs, (50, None), (51, ""), (None, items[4][1]), (1, docs[1][1]), (1, docs[1][1]), (52, "from " * 500 + word()), (53, "some no id but words here"), (54, "a b c a b c " * 4)], items


def test_against_brute_force(spark):
    docs, items = tables()
    want = sorted(brute(docs, items), key=repr)
    frame = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, n_words long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for sent, most in ((decontaminate.SENT, decontaminate.BITS), (0, 1 << 10)):  # the second: joins by shuffle, bit sets that let much through
        assert sorted((tuple(r) for r in decontaminate.overlaps(frame, bench, sent=sent, most=most).collect()), key=repr) == want
        kept = decontaminate.drop_contaminated(frame, bench, sent=sent, most=most)
        assert kept.columns == frame.columns
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in want if not r[5]), key=repr)


def test_empty_tables(spark):
    docs, items = tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.n_words for r in decontaminate.overlaps(frame, bench.where("item_id < 0")).collect())) == sorted(len(words_of(x)) for _, x in docs)
    assert decontaminate.overlaps(frame.where("doc_id < 0"), bench).count() == 0


def test_clashing_columns_and_a_very_long_text(spark):
    _, items = tables()
    long = "q " * 400_000 + items[5][1] + " q" * 400_000
    docs = spark.createDataFrame([(1, long, b"k", 1, "s"), (2, "from " * 20, b"k", 2, "s"), (3, None, None, None, None)], "doc_id long, text string, key binary, digest long, Seeds string")
    bench = spark.createDataFrame([(*x, 1) for x in items if x[1] and len(x[1].split()) > 12], "item_id long, text string, fp int")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    got = {r.doc_id: r.n_words for r in decontaminate.overlaps(docs, bench).collect()}
    assert got[1] > 800_000 and got[2] == 20 and got[3] == 0


def test_a_passage_in_every_document(spark):
    rng = random.Random(1)
    passage = " ".join(rng.choice("abcdefg") * 3 for _ in range(40))
    docs = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(300)] + [(1000 + i, passage) for i in range(300)]
    items = [(i, passage) for i in range(50)]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(docs, items))
