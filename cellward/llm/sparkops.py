"""Spark helpers of the operators: reading tables, cutting lineage, keys that survive nulls and repeats."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in join keys.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares.  A local one only where the setting is unset and the master is local, as in tests."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Run it once and go on from files in the shared folder; they outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(df: DataFrame) -> DataFrame:
    """As ``cut``, and the shuffle files behind it are deleted with it, not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return cut(df.select("*"))  # a query takes the setting of the time it is made
    finally:
        conf.set(name, before)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Holds a setting for the queries that are made, or run, within."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, by a table in the shared folder.  For loops of joins: a checkpoint keeps the plan's estimated size, which
    joins multiply, so that it has four times the digits after each round and fills the driver after a dozen."""
    path = fresh_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(big: DataFrame, small: DataFrame, key: str, weight: str, salt: list[str], how: str = "left") -> DataFrame:
    """``big`` joined with ``small`` on ``key``, of which ``small`` has each value once, with its rows in ``big`` as ``weight``.

    A key with more than its task's share of the rows (at most as many keys as there are partitions) is parted by
    a hash of the ``salt`` columns, and its row of ``small`` is repeated for each part.
    """
    spark = big.sparkSession
    n = partitions(spark)
    total = small.agg(F.sum(weight)).first()[0] or 0
    part, parts = free_names([*big.columns, *small.columns], "part", "parts")
    hot = small.where(F.col(weight) * n > total).select(key, F.ceil(F.col(weight) * n / F.lit(total or 1)).cast("int").alias(parts))
    hot = F.broadcast(cut(hot))  # at most n rows
    left = big.join(hot, key, "left").withColumn(part, F.when(F.col(parts).isNotNull(), F.pmod(F.xxhash64(*salt), F.col(parts))).otherwise(F.lit(0))).drop(parts)
    right = small.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(parts), F.lit(1)).cast("bigint") - 1))).drop(parts)
    return left.withColumn(part, F.col(part).cast("bigint")).join(right, [key, part], how).drop(part)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """The table, run once, and marked for broadcast if it has no more than ``rows`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def dealt(rows: DataFrame, keys: list[str], salt: str, block: int, few: int = 1 << 16) -> DataFrame:
    """The rows with ``block``, ``i`` and ``j``: the rows of one key that have the same i and j make a task's work.

    The rows of a key that has more than ``block`` of them fall into blocks by a hash of ``salt``, and every pair of
    blocks i <= j gets the rows of both; other keys have the one block 0.
    """
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks") > block)
    large = sized(large.select(*keys, F.ceil(F.col("blocks") / block).cast("int").alias("blocks")), few)
    rows = rows.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(salt), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def by_group(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work(batch, bounds)`` yields record batches; group k of the batch are the rows from bounds[k] to bounds[k + 1], all that have its keys."""

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in map(batch.schema.get_field_index, keys):
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            bounds = [0, *np.flatnonzero(new).tolist()]
            held = batch.slice(bounds[-1])  # it may go on
            if bounds[-1]:
                yield from work(batch.slice(0, bounds[-1]), bounds)
        if held is not None:
            yield from work(held, [0, held.num_rows])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def free_names(columns, *wanted: str) -> list[str]:
    """Names for helper columns like the wanted ones that differ, without case, from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def carried(docs: DataFrame, stage) -> DataFrame:
    """``stage(docs)``, which returns the columns of docs, where names may hold dots and backticks: those have plain ones meanwhile."""
    odd = [c for c in docs.columns if "." in c or "`" in c]
    plain = dict(zip(odd, free_names(docs.columns, *(f"column{i}" for i in range(len(odd))))))
    return stage(docs.toDF(*(plain.get(c, c) for c in docs.columns))).toDF(*docs.columns) if odd else stage(docs)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that extra columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
