import random
import re

from cellward.llm import licenses


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    words, places = words_of(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_automaton_against_brute_force():
    rng = random.Random(4)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(6)]
    own = licenses.Automaton(sequences)
    probe = [rng.randrange(4) for _ in range(200)]
    for i, (length, state) in enumerate(own.statistics(probe)):
        best = max(n for n in range(i + 2) if n == 0 or any(probe[i + 1 - n : i + 1] == s[k : k + n] for s in sequences for k in range(len(s) - n + 1)))
        assert length == best
        if length:
            assert own.ends[state] == {(a, k + length) for a, s in enumerate(sequences) for k in range(len(s) - length + 1) if s[k : k + length] == probe[i + 1 - length : i + 1]}


def test_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [
        (1, "Released under the MIT license. CC-BY-NC, cc by nc"),
        (2, None),
        (3, ""),
        (4, "x " * 30 + mit.upper() + " y"),
        (5, "only permission is hereby granted free of charge"),
        (None, "Apache License, Version 2.0 under the mit license"),
        (6, "under the mit"),
        (7, "license under"),
        (1, "Released under the MIT license. CC-BY-NC, cc by nc"),
        (8, "This work is licensed under the GNU General Public License, version 3."),
        (9, "under the mit license " * 500 + "é"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    want = [(i, *brute(x)) for i, x in rows]
    assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in got}
    assert by[4].labels == "mit" and by[4].score == 1.0 and not by[4].base_labels
    assert by[5].labels == "" and 0 < by[5].score < 0.8
    assert by[8].labels == "gpl-3"
    assert by[1].labels == "cc-by-nc,mit"
    assert licenses.scan(docs.where("doc_id < 0")).count() == 0


def test_changed_words_do_not_end_a_licence():
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    half, again = int(len(words) * 0.61), len(words) // 3
    bodies = [
        mit.replace("Software", "Library"),
        " ".join([*words[:half], "zzgarble", *words[half + 1 :]]),
        " ".join(w if i % 12 else f"{i} qq {w}" for i, w in enumerate(words)),
        "The above copyright notice and this permission notice shall be included in qq",
        " ".join([*words[:again], *["qq"] * 500, *words[2 * again :]]),
        " ".join([*words[2 * again :], *words[:again]]),
        licenses.TEMPLATES["isc"].replace("appear", "zz stand"),
    ]
    own = licenses.Scanner()
    _, _, shares = own.scan([x.encode() for x in bodies])
    number = own.labels.index("mit")
    assert all(shares[i][number] >= licenses.COVER for i in range(3))
    assert all(shares[i][number] < 0.5 for i in (3, 4, 5))
    assert shares[6][own.labels.index("isc")] >= licenses.COVER
