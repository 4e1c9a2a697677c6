import random
import zlib

import numpy as np
import pytest

from cellward.llm import token_files
from cellward.llm.bpe import vocabulary
from cellward.llm.tokens import BYTE_LEVEL, codec


@pytest.mark.parametrize("n", [1, 3, 4, 1000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(0, 70000).astype(np.uint32)
    doc_ids, sizes, back = token_files.unpack(token_files.pack([5, None], [1, n - 1], ids))
    assert doc_ids == [5, None] and sizes.tolist() == [1, n - 1] and back.tolist() == ids.tolist()


def test_files_against_library(spark, tmp_path):
    rows = [(9, "thatan oush one"), (2, None), (7, ""), (-1, "Été <|endoftext|>  x"), (9, "another"), (None, "null id"), (3, "日本 text " * 40)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    folder = f"file://{tmp_path}/files"
    path = vocabulary("byte_bpe_50k.json")
    manifest = token_files.write(docs, path, folder, file_ids=60)
    got = sorted((tuple(r) for r in token_files.read(spark, folder).collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*codec(path).library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert sum(r.n_ids for r in manifest.collect()) == at


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert token_files.op5_token_id_output(spark, str(tmp_path)).count() == 0


def test_words_are_the_first_attempt_of_the_pattern():
    """Most pieces are words, which the pattern tries first; ids are the library's whatever white space and contractions stand where."""
    assert BYTE_LEVEL.startswith(r" ?\p{L}+|")
    own, rng = codec(vocabulary("byte_bpe_50k.json"), token_files.DEAL), random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\t", "\xa0", "\x85", "\x1c", "\x0b", "it's", "don't,", "x", "Été", "12,5", "(a)", "...", "'", "'s", " 's", "'9", "'ll", "\u00ad", "<", "end."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(4000)] + ["", " ", "It's a 'so-called' test, isn't it? Yes. 3 of 4"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids, text
