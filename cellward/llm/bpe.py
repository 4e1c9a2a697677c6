"""BPE encoding and decoding by tree concatenation.

Every piece of over ``tokens.LEAF`` symbols is encoded as a tree: halves of halves apart, joined pair by pair
(``tokens.Codec.join``).  In most texts the pieces are short and their trees grow inside one map.  A text with an
unsplit run of over DEAL characters is cut into rows: its short pieces, and the halves of halves of each long
piece down to DEAL.  The rows are dealt out and encoded in parallel; then FAN neighbours are joined at a time,
level by level, each group in a task of its own, until every piece is one row.

Nulls: a null text is empty and has no ids; a null doc_id is kept.  Repeated rows give one row each.  Other
columns of the documents aren't looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm import textops as t
from cellward.llm.sparkops import cut, partitions, table, texts
from cellward.llm.tokens import DEAL, codec

#: Short pieces in one row of a text with long ones, and parts that one task joins.
RUN, FAN = 2048, 16
PART = "doc_id long, key string, copies long, piece long, part long, of long"
ENCODED = "doc_id long, ids binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _plain(own, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _digest(own, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            doc_id,
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _encode(path: str, finish):
    def run(batches):
        own = codec(path)
        for batch, bodies in t.slices(batches):
            yield finish(own, batch.column(0), own.encode([b.decode("utf-8", "replace") for b in bodies]))

    return run


def _finish(path: str, finish):
    def run(batches):
        own = codec(path)
        for batch in batches:
            yield finish(own, batch.column(0), batch.column(1).to_pylist())

    return run


def _cut(path: str, deal: int):
    def run(frames):
        own = codec(path)
        for frame in frames:
            for doc_id, key, copies, text in frame.itertuples(index=False):
                rows, short = [], []

                def flush(rows=rows, short=short):
                    if short:
                        rows.append((rows[-1][0] + 1 if rows else 0, 0, 0, "\n".join(short)))
                        short.clear()

                for kind, symbols in own.split(text):
                    if kind == "piece" and len(symbols) > deal:
                        flush()
                        parts, piece = own.leaves(symbols, deal), rows[-1][0] + 1 if rows else 0
                        rows += [(piece, i, len(parts), x) for i, x in enumerate(parts)]
                    else:
                        short.append(f"\t{symbols}" if kind == "id" else symbols)
                        if len(short) >= RUN:
                            flush()
                flush()
                for piece, part, of, symbols in rows or [(0, 0, 0, "")]:
                    yield pd.DataFrame({"doc_id": pd.array([doc_id], "Int64"), "key": [key], "copies": [copies], "piece": [piece], "part": [part], "of": [of], "symbols": [symbols]})

    return run


def _leaves(path: str):
    def run(frames):
        own = codec(path)
        for frame in frames:
            ids = []
            for of, symbols in zip(frame["of"], frame["symbols"]):
                if of:
                    ids.append(np.array(own.tree(symbols), "<u4").tobytes())
                else:
                    got: list[int] = []
                    for x in symbols.split("\n") if symbols else ():
                        got += [int(x[1:])] if x[0] == "\t" else own.tree(x)
                    ids.append(np.array(got, "<u4").tobytes())
            yield frame.drop(columns="symbols").assign(ids=ids)

    return run


def _join(path: str, fan: int):
    """Joins up to ``fan`` neighbouring parts of a piece to one part of the next level."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        ids = codec(path).concatenate([np.frombuffer(x, "<u4").tolist() for x in frame["ids"]])
        return frame.head(1).assign(part=frame["part"] // fan, of=-(-frame["of"] // fan), ids=[np.array(ids, "<u4").tobytes()])

    return run


def _whole(frame: pd.DataFrame) -> pd.DataFrame:
    """A document's ids from those of its pieces, once for each copy of it."""
    n = int(frame["copies"].iloc[0])
    return pd.DataFrame({"doc_id": pd.array([frame["doc_id"].iloc[0]] * n, "Int64"), "ids": [b"".join(frame.sort_values("piece")["ids"])] * n})


def encode(docs: DataFrame, path: str, deal: int = DEAL, fan: int = FAN) -> DataFrame:
    """doc_id and the ids of its whole text (little-endian unsigned 32-bit)."""
    return _encoded(docs, path, deal, fan, _plain, ENCODED)


def digest(docs: DataFrame, path: str, deal: int = DEAL, fan: int = FAN) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them."""
    return _encoded(docs, path, deal, fan, _digest, DIGEST)


def _encoded(docs: DataFrame, path: str, deal: int, fan: int, finish, schema: str) -> DataFrame:
    rows = texts(docs)
    long_run = F.coalesce(F.col("text").rlike(f"\\S{{{deal + 1}}}|\\s{{{deal + 1}}}"), F.lit(False))
    whole = rows.where(~long_run).mapInArrow(_encode(path, finish), schema)
    parts = cut(
        rows.where(long_run)
        .groupBy("doc_id", F.sha2("text", 256).alias("key"))
        .agg(F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text"))
        .mapInPandas(_cut(path, deal), f"{PART}, symbols string")
        .repartition(partitions(docs.sparkSession), "doc_id", "key", "piece", "part")
        .mapInPandas(_leaves(path), f"{PART}, ids binary")
    )
    most = parts.agg(F.max("of")).first()[0]
    if most is None:
        return whole
    while most > 1:
        joined = parts.where("of > 1").groupBy("doc_id", "key", "piece", F.floor(F.col("part") / fan).alias("group")).applyInPandas(_join(path, fan), f"{PART}, ids binary")
        parts, most = parts.where("of <= 1").unionByName(joined), -(-most // fan)
    cut_up = parts.groupBy("doc_id", "key").applyInPandas(_whole, ENCODED).mapInArrow(_finish(path, finish), schema)
    return whole.unionByName(cut_up)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of rows with ids."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            text = [own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
