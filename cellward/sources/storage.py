"""Tables in the shared storage: reading, read-or-build, checkpoints, and partition listings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where nothing is set and the master is local."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Run it once and go on from a table in the shared folder.

    Not a checkpoint: that keeps the plan's estimated size, which joins multiply, so that a loop of joins squares it each
    round until the driver runs out of memory.  A table has the size of its files.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """The table, for joins that go by shuffle: a table that grows with the input isn't broadcast.

    Spark takes a table for as large as its files, which are compressed, and an exploded one for as large as a row of it for each row
    before; where that is under the limit of broadcasts the table went through the driver.
    """
    return df.hint("merge")


def sized(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """The table, run once, and marked for broadcast if it has no more than ``rows`` rows, else for a join by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else shuffled(df)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there; none is an error."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored table, built and stored first if it isn't there."""
    if not exists(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def publish(df: DataFrame, path: str) -> int:
    """A new version of a table, seen by readers as a whole or not at all: rows first, then the version's number in a list of versions.

    Writers must take turns: of two that begin at once, the later one finds its folder taken and fails.
    """
    spark = df.sparkSession
    versions = f"{path}/versions"
    last = spark.read.parquet(versions).agg(F.max("v")).first()[0] if exists(spark, versions) else 0
    df.write.mode("errorifexists").parquet(f"{path}/{last + 1}")
    spark.range(last + 1, last + 2).select(F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(versions)
    return last + 1


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table."""
    return spark.read.parquet(f"{path}/{spark.read.parquet(f'{path}/versions').agg(F.max('v')).first()[0]}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Statistics with a header and a schema of their own; malformed numbers stay text until P6."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    """K6: a summary as one file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_layers(cells: DataFrame, path: str) -> None:
    """K1, K7: layers by scenario and indicator, so a reader prunes to the ones it asks for."""
    cells.write.mode("overwrite").partitionBy("scenario", "indicator").parquet(path)


def layers(spark: SparkSession, path: str) -> DataFrame:
    """Which layers there are, from the partition folders."""
    return spark.read.parquet(path).select("scenario", "indicator").distinct()


def write_exposition(cells: DataFrame, value: str, path: str) -> bool:
    """K2: negative values as 0; an all-zero layer isn't written."""
    clipped = cells.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    if not clipped.where(F.col(value) > 0).limit(1).count():
        return False
    clipped.write.mode("overwrite").parquet(path)
    return True


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """A scan that must have certain columns."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def code_column(df: DataFrame, candidates: tuple[str, ...] = ("NUTS_ID", "nuts_id", "geo", "GEOCODE")) -> str:
    """The first of the candidate code columns."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return found


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Key, last_modified, size of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("modificationTime").alias("last_modified"), F.col("length").alias("size"))


TILES = "file string, kind string, name string, value string, zoom_level int, tile_column int, tile_row int, tile_data binary"


def _mbtiles(batches):
    import sqlite3

    import pyarrow as pa

    for batch in batches:
        for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            db = sqlite3.connect(":memory:")
            db.deserialize(body)
            tables = {r[0] for r in db.execute("select name from sqlite_master")}
            rows = [(path, "metadata", n, v, None, None, None, None) for n, v in db.execute("select name, value from metadata")] if "metadata" in tables else []
            source = "tiles" if "tiles" in tables else "map"
            names = {r[1] for r in db.execute(f"pragma table_info({source})")}
            z, x, y, data = ("zoom_level", "tile_column", "tile_row", "tile_data") if "zoom_level" in names else ("z", "x", "y", "tile_data" if "tile_data" in names else "data")
            rows += [(path, "tile", None, None, *r) for r in db.execute(f"select {z}, {x}, {y}, {data} from {source}")]
            db.close()
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            fields = [c.split()[0] for c in TILES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=fields)


def mbtiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata (file, name, value) and tiles (file, zoom_level, tile_column, tile_row, tile_data) of tile
    databases in any of three dialects; each file is opened in a task of its own."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_mbtiles, TILES)
    return rows.where("kind = 'metadata'").select("file", "name", "value"), rows.where("kind = 'tile'").select("file", "zoom_level", "tile_column", "tile_row", "tile_data")


def feature(geometry: str, properties: list[str]) -> Column:
    """A GeoJSON feature; the geometry column is JSON text."""
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), F.col(geometry), F.lit("}"))


def drop_missing(df: DataFrame) -> DataFrame:
    """NaN is a missing value: null from the scan on."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
