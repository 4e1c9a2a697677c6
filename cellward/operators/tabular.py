"""Relational steps on statistical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellward.operators.normalise import beside, normalise
from cellward.sources.storage import cut


def number(text: Column) -> Column:
    """A number, or null where the text isn't one."""
    return text.try_cast("double")


def regional(df: DataFrame, geo: str, prefix: str, length: int, unit: str | None = None, part: str | None = None) -> DataFrame:
    """Codes of one country and level, and of units that contain a part."""
    out = df.where(F.col(geo).startswith(prefix) & (F.length(geo) == length))
    return out.where(F.col(unit).contains(part)) if unit else out


def latest(df: DataFrame, period: str) -> DataFrame:
    """The rows of the latest period; one aggregate row is sent to every task, there is no sort."""
    return df.crossJoin(F.broadcast(df.agg(F.max(period).alias("__last")))).where(F.col(period) == F.col("__last")).drop("__last")


def starred_period(df: DataFrame, label: str, wanted: str = "2022*") -> DataFrame:
    """The wanted period label if there is one, else the last that has a star and is no quarter."""
    yearly = F.col(label).contains("*") & ~F.lower(label).contains("kwartaal")
    pick = df.agg(F.max(F.when(F.col(label) == wanted, F.col(label))).alias("a"), F.max(F.when(yearly, F.col(label))).alias("b"))
    return df.crossJoin(F.broadcast(pick.select(F.coalesce("a", "b").alias("__label")))).where(F.col(label) == F.col("__label")).drop("__label")


def tonnes(value: Column, unit: Column) -> Column:
    """Thousand tonnes to tonnes, row by row."""
    return F.when(unit == "THS_T", value * 1000).otherwise(value)


def remap(df: DataFrame, code: str, mapping: DataFrame, out: str) -> DataFrame:
    """The new code of (old, new), or the code itself."""
    return df.join(mapping.select(F.col("old").alias(code), F.col("new").alias("__new")), code, "left").withColumn(out, F.coalesce("__new", code)).drop("__new")


def outer_sum(left: DataFrame, right: DataFrame, keys: list[str], value: str, unit: str = "T") -> DataFrame:
    """Full outer join of two tables, nulls as 0, sums above 0 with one unit."""
    both = left.select(*keys, F.col(value).alias("__l")).join(right.select(*keys, F.col(value).alias("__r")), keys, "full_outer")
    return both.select(*keys, F.coalesce("__l", F.lit(0.0)).alias("loading"), F.coalesce("__r", F.lit(0.0)).alias("unloading")).withColumn(value, F.col("loading") + F.col("unloading")).where(F.col(value) > 0).withColumn("unit", F.lit(unit))


def share_out(df: DataFrame, zone: str, weight: str, totals: DataFrame, total: str, out: str) -> DataFrame:
    """A zone's total over its rows by weight, or evenly where all weights are 0.

    The zone's sums are aggregated before the join, so a zone with most of the rows makes no large window.
    """
    sums = df.groupBy(zone).agg(F.sum(weight).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    full = beside(df, sums.join(totals.select(zone, total), zone), [zone])
    part = F.when(F.col("__sum") > 0, F.col(total) * F.col(weight) / F.col("__sum")).otherwise(F.col(total) / F.col("__n"))
    return full.withColumn(out, part).drop("__sum", "__n", total)


def distinct_total(df: DataFrame, value: str) -> DataFrame:
    """A4: regions told apart by value alone, so equal values count once."""
    v = F.when(F.col(value) != 0, F.col(value))
    return df.agg(F.sum_distinct(v).alias("total"), F.count_distinct(v).alias("n_values"))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n in an order that leaves no ties open."""
    return df.orderBy(*order).limit(n)


def single(df: DataFrame, what: str = "row"):
    """O3: the only row, None if there is none; two are an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"more than one {what}")
    return rows[0] if rows else None


def upsert(base: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of each key the row with the highest version."""
    w = Window.partitionBy(*key).orderBy(F.col(version).desc())
    return base.unionByName(changes).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def incremental(found: DataFrame, done: DataFrame) -> DataFrame:
    """K8: (path, mtime) that no finished run covers: never done, or changed since."""
    return found.join(done.select("path", F.col("mtime").alias("__done")), "path", "left").where(F.col("__done").isNull() | (F.col("mtime") > F.col("__done"))).drop("__done")


def coverage(df: DataFrame, kind: str, ok: Column) -> DataFrame:
    """Counts and success rate by kind."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok")).withColumn("rate", F.col("n_ok") / F.col("n"))


def ordinal(df: DataFrame, order: list, out: str) -> DataFrame:
    """Rows with their place in an order, from 0, without bringing them all to one task.

    Rows are dealt to ranges of the order; a range's first place is the number of rows before it, one count for each range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumns({"__range": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__range").withColumn(out, F.col("__before") + F.col("__in")).drop("__at", "__range", "__in", "__before")


def with_shares(zones: DataFrame, shares: DataFrame, code: str) -> DataFrame:
    """Zones with their shares by code; no match at all is an error."""
    out = zones.join(shares, code)
    if not out.limit(1).count():
        raise ValueError(f"no zone has a share by {code}")
    return out


def with_values(zones: DataFrame, values: DataFrame, code: str, value: str) -> DataFrame | None:
    """All zones with their values by code, null where there is none; None if no zone has one, as such a table is left out."""
    found = values.where(F.col(value).isNotNull())
    if not zones.join(found, code, "left_semi").limit(1).count():
        return None
    return zones.join(found, code, "left")


def normalised_table(df: DataFrame, value: str, out: str) -> DataFrame:
    """A table's values above 0 rescaled as an economic layer, all others 0."""
    return normalise(df, value, "economic", F.col(value) > 0, out)
