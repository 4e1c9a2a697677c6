"""The pipeline against the stages' plain versions, one after the other, on a small table."""

import hashlib
import random

import numpy as np
import pytest

from cellward.llm import bpe, quality
from cellward.llm.tokens import codec
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near import brute as grouped

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def tables():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("thean orins".replace(" ", "")) for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(25)) for i in range(5)]
    docs = [(i, prose(120)) for i in range(40)]
    docs += [(50, docs[3][1]), (51, docs[4][1] + " more"), (52, prose(20)), (53, f"{prose(70)} {items[1][1]}"), (54, f"{prose(80)} token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff {prose(30)}"), (55, None), (56, "")]
    docs.append((2, docs[2][1]))
    return docs, items


def test_pipeline(spark, tmp_path):
    docs, items = tables()
    rows = [(i, x, "en", "s", len(x) if x is not None else None) for i, x in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in quality.judge(frame).collect() if r.kept}
    assert kept == {i for i, _ in docs} - {52, 55, 56}
    left = [(i, x) for i, x in docs if i in kept]
    first = {c for _, c, _, _ in grouped(left)}
    left = list({i: x for i, x in left if i in first}.items())
    left = [(i, x) for (i, x), r in zip(left, contaminated(left, items)) if not r[5]]
    assert {50, 51, 53}.isdisjoint(i for i, _ in left)
    own, want = codec(bpe.vocabulary("word_bpe_49k.json")).library, []
    for i, x in left:
        x = x.replace("token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "[SECRET]")
        ids = own.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
