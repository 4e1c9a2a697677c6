import hashlib
import random

import numpy as np
import pytest

from cellward.llm import bpe
from cellward.llm.tokens import LEAF, codec

WORD, BYTE = bpe.vocabulary("word_bpe_49k.json"), bpe.vocabulary("byte_bpe_50k.json")
TEXTS = [
    "", " ", "Hello  world's  don't\n\tX9\x85y\xa0z", "<|endoftext|> a <|startoftext|>b<|endoftext|", "Été ÀÉ ß İstanbul", "日本語のテキスト123", "éä 가", "''s'll####'s a\x00b\x1cc",
    "a\r\n\r\n  b   c \n", "…—’s", "x" * 50, "tab\tend ", "½²ª" * 3, "🙂🙃", "don't" * 20,
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    own = codec(path)
    for text, ids in zip(TEXTS, own.encode(TEXTS)):
        assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_is_exact(path):
    own, rng = codec(path), random.Random(3)
    for alphabet in ("ab", "aehnotr", "abcdefghijklmnopqrstuvwxyz", "#*!'-", "é"):
        for n in (1, 2, 7, 30, 200, 900):
            piece = own.symbols("".join(rng.choice(alphabet) for _ in range(n)))
            for leaf in (1, 3, 16):
                assert own.tree(piece, leaf) == own.leaf_ids(piece), (alphabet, n, leaf)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_code_point_alone_and_inside_a_word(path):
    own = codec(path)
    for block in range(0, 0x10000, 0x400):
        chars = [chr(c) for c in range(block, block + 0x400) if not 0xD800 <= c < 0xE000]
        texts = [x for c in chars for x in (c, f"ab{c}Cd", f"Aa {c} 1{c}")]
        for text, ids, want in zip(texts, own.encode(texts), own.library.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(text)


def test_words_longer_than_a_leaf_are_trees():
    own, rng = codec(WORD), random.Random(11)
    words = ["".join(rng.choice(["th", "er", "ing", "tion", "qu", "é", "Ö", "x"]) for _ in range(rng.randint(8, 40))) for _ in range(3000)]
    calls, tree = [], own.tree
    own.tree = lambda symbols, *more: calls.append(symbols) or tree(symbols, *more)
    try:
        got = own.encode([f"{w}, {w}!" for w in words])
    finally:
        own.tree = tree
    assert len(calls) == len({w.lower() for w in words if len(w.lower().encode()) > LEAF})
    for w, ids in zip(words, got):
        assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(f"{w}, {w}!", add_special_tokens=False).ids, w


def test_spark_against_library(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("thean orinst"[:5]) for _ in range(700))
    texts = [*TEXTS, None, long, f"a {long} b,{long[:300]}<|endoftext|>{long} end", long, f"日{long}"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, long), (3, "again"), (16, long), (16, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for path in (WORD, BYTE):
        own = codec(path).library
        want = []
        for i, x in rows:
            ids = own.encode(x or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = [tuple(r) for r in bpe.digest(docs, path, deal=64, fan=3).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, ids string, key long")
    assert bpe.digest(docs, WORD).count() == 1
    assert bpe.digest(docs.where("doc_id > 1"), WORD).count() == 0
