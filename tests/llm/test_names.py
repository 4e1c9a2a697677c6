"""Columns with dots, backticks and clashing names go through the stages unchanged."""

import pytest
from pyspark.sql import functions as F

from cellward.llm import decontaminate, near, quality, secrets

EXTRA = ("a.b", "c`d", "x y", "Struct", "key", "runs", "text.x")


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"word{k} und noch etwas mehr davon" for k in range(40))
    rows = [(k, f"{words} nummer {k}" if k < 4 else words[k:], "de", "s", k) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{name}="), F.col("doc_id").cast("string")).alias(name) for name in EXTRA))


@pytest.mark.parametrize("stage", ["quality", "near", "decontaminate", "secrets"])
def test_any_name_is_carried_along(spark, docs, stage):
    benchmark = spark.createDataFrame([(1, "etwas ganz anderes " * 9)], "item_id long, text string")
    run = {"quality": quality.keep, "near": near.keep_first, "decontaminate": lambda d: decontaminate.drop_contaminated(d, benchmark), "secrets": secrets.redact}[stage]
    out = run(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[name] == f"{name}={r.doc_id}" for r in rows for name in EXTRA) and (rows or stage == "quality")
