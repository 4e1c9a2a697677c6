"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A file is, all little-endian: the magic ``RVB1``; unsigned 32-bit numbers of ranks and of documents and a
64-bit number of ids; the ids by falling frequency in this file (32 bits each); for each document its doc_id
(64 bits), a byte that is 1 for a null doc_id, and its number of ids (64 bits); the control bytes, two bits an
id, for the 1 to 4 bytes of its rank; the ranks' bytes.  Decoding takes lengths from a 256 by 4 table.

Documents stand in ascending order of doc_id (nulls first; repeated ids by text), in files named by partition
and number, so the names' order is the documents'.  A task writes a file under a name of its own and renames
it, so a lost or repeated task leaves whole files of equal content.  Nulls: a null text is empty.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellward.llm import textops as t
from cellward.llm.bpe import vocabulary
from cellward.llm.sparkops import cut, fresh_dir, partitions, table, texts
from cellward.llm.tokens import DEAL, codec

MAGIC, END = b"RVB1", 0
#: Ids in a file at most, but for one document more.
FILE_IDS = 4_000_000
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    count = np.bincount(ids, minlength=1)
    by_rank = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    rank_of = np.zeros(len(count), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = rank_of[ids]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    head = MAGIC + struct.pack("<IIQ", len(by_rank), len(doc_ids), len(ids))
    null = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, by_rank.astype("<u4").tobytes(), names.tobytes(), null.tobytes(), np.array(sizes, "<u8").tobytes(), control.tobytes(), data.tobytes()])


def unpack(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each document, all ids."""
    if body[:4] != MAGIC:
        raise ValueError("not a token file")
    n_ranks, n_docs, n_ids = struct.unpack_from("<IIQ", body, 4)
    at = 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, n, at)
        at += out.nbytes
        return out

    by_rank, names, null, sizes = take("<u4", n_ranks), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    size = _LENGTHS[take("u1", -(-n_ids // 4))].ravel()[:n_ids]
    wide = np.zeros((n_ids, 4), np.uint8)
    wide[np.arange(4) < size[:, None]] = take("u1", int(size.sum()))
    return [None if x else d for d, x in zip(names.tolist(), null.tolist())], sizes.astype(np.int64), by_rank[wide.view("<u4").ravel()]


def _write(path: str, folder: str, file_ids: int):
    def run(batches):
        from pyarrow import fs

        own = codec(path, DEAL)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        number, doc_ids, sizes, parts, total = 0, [], [], [], 0

        def close():
            nonlocal number, total
            name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}.rvb"
            part = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(pack(doc_ids, sizes, np.concatenate(parts)))
            store.move(part, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64())], names=["file", "n_docs", "n_ids"])
            number, total = number + 1, 0
            doc_ids.clear(), sizes.clear(), parts.clear()
            return row

        end = np.array([END], np.uint32)
        for batch, bodies in t.slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode([b.decode("utf-8", "replace") for b in bodies])):
                parts += [np.frombuffer(ids, "<u4"), end]
                doc_ids.append(doc_id)
                sizes.append(len(ids) // 4 + 1)
                total += sizes[-1]
                if total >= file_ids:
                    yield close()
        if doc_ids:
            yield close()

    return run


def write(docs: DataFrame, path: str, folder: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes all documents and writes the files; returns their manifest (file, n_docs, n_ids)."""
    ordered = texts(docs).repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(ordered.mapInArrow(_write(path, folder, file_ids), "file string, n_docs long, n_ids long"))


def _read(batches):
    for batch in batches:
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc_ids, sizes, ids = unpack(body)
            end = np.cumsum(sizes)
            start = end - sizes
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(start.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(sizes)), pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document in the files of a folder: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rvb").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(_read, "file string, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")
    rows = cut(rows)
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "token-files")
    manifest = write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder)
