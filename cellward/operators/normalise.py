"""Rescaling of layers in a few passes: aggregate, join the one row of each group back, project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellward.plans.config import NORMALISERS, Normaliser
from cellward.sources.storage import sized

#: Bins of a pass of ``percentiles``, and passes before the last bin's values are ordered.
BINS, PASSES = 4096, 2


def _joined(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    return df.join(small, by) if by else df.crossJoin(F.broadcast(small))


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles of each group, one column for each share, interpolated between neighbours.

    A pass counts the values in BINS bins between a group's least and largest and goes on with the bin that holds the
    wanted rank, so what is ordered in the end is about one in BINS ** PASSES of a group's values.  No value is
    gathered: passes shuffle at most BINS counts for each group and share from each task.  Nulls don't count.
    The layer is scanned and never shuffled: the groups' bins are broadcast behind a count.  Without groups there is one row.
    """
    by = by or []
    own = df.select(*by, value.cast("double").alias("__v")).where("__v is not null")
    names = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in shares.items())))
    base = own.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = base.select(*by, "__lo", "__hi", "__n", names.alias("__s")).select(*by, "__lo", "__hi", F.col("__s.name").alias("__name"), (F.col("__s.share") * (F.col("__n") - 1)).alias("__h"))
    # rank within [lo, hi], the way to the next value, and the least value above hi
    wanted = sized(wanted.withColumns({"__r": F.floor("__h"), "__f": F.col("__h") - F.floor("__h"), "__next": F.lit(None).cast("double")}).drop("__h"))
    keep = [*by, "__name"]
    for _ in range(PASSES):
        near = _joined(own, wanted.select(*keep, "__lo", "__hi"), by).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        width = F.col("__hi") - F.col("__lo")
        bin_ = F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        bins = near.groupBy(*keep, bin_.alias("__bin")).agg(F.count(F.lit(1)).alias("__k"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        w = Window.partitionBy(*keep).orderBy("__bin")
        bins = bins.withColumns({"__upto": F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.lead("__least").over(w)})
        found = wanted.join(bins.drop("__bin"), keep).where((F.col("__upto") > F.col("__r")) & (F.col("__upto") - F.col("__k") <= F.col("__r")))
        wanted = sized(found.select(*keep, F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), (F.col("__r") - F.col("__upto") + F.col("__k")).alias("__r"), "__f", F.coalesce("__after", "__next").alias("__next")))
    last = _joined(own, wanted.select(*keep, "__lo", "__hi"), by).where(F.col("__v").between(F.col("__lo"), F.col("__hi"))).groupBy(*keep, "__v").agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(*keep).orderBy("__v")
    last = last.withColumns({"__upto": F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.lead("__v").over(w)})
    hit = wanted.join(last, keep).where((F.col("__upto") > F.col("__r")) & (F.col("__upto") - F.col("__k") <= F.col("__r")))
    above = F.when(F.col("__upto") > F.col("__r") + 1, F.col("__v")).otherwise(F.coalesce("__after", "__next", "__v"))
    got = hit.select(*by, "__name", (F.col("__v") + F.col("__f") * (above - F.col("__v"))).alias("__p"))
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("__name") == name, F.col("__p"))).alias(name) for name in shares))


def statistics(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, deviation, extremes, upper percentiles of each group."""
    plain = df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    ranked = percentiles(df, value, {"median": 0.5, "p95": 0.95, "p99": 0.99}, by)
    return plain.join(ranked, by, "left") if by else plain.join(F.broadcast(ranked), how="left")


def beside(df: DataFrame, stats: DataFrame, by: list[str] | None) -> DataFrame:
    """Rows with their group's statistics, without a shuffle of the rows.

    Statistics of groups are run once and broadcast behind a count; beyond it there are so many groups that the join goes by shuffle.
    Without groups there is one row, which every task gets.
    """
    return _joined(df, stats if not by else sized(stats), by or [])


def rescaled(v: Column, p: Normaliser, top: Column, p99: Column) -> Column:
    """One masked value, given the masked maximum and 99th percentile."""
    small = F.when(top < 0.8, v * 0.9 / top).otherwise(v) if p.boost else v
    weak = F.when(top < 0.95, v / top).otherwise(v) if p.boost else v
    large = F.when(p99 > p.ceiling, v * p.ceiling / p99).otherwise(F.least(v, F.lit(1.0)))
    out = F.when(top > 1, large).otherwise(small if p.preserve else weak)
    out = F.when(out > p.ceiling, p.ceiling + 0.02 * F.tanh((out - p.ceiling) / 0.1)).otherwise(out)
    return F.greatest(out, F.lit(p.floor))


def normalise_all(df: DataFrame, kind: str, columns: dict[str, tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """N1 to N5 by kind (N7), for several columns at once: {new column: (column, mask)}.

    Cells outside a mask get 0, masked zeros the floor.  Unknown kinds raise.  The statistics of all columns come from
    one set of passes over (name, value) rows; they are a row for each group, cut, so that the layer stands once in the plan.
    """
    if kind not in NORMALISERS:
        raise ValueError(f"no normaliser named {kind}")
    by, own = by or [], {}
    for out, (value, mask) in columns.items():
        inside = F.coalesce(mask, F.lit(False)) & F.col(value).isNotNull()
        own[out] = (inside & (F.col(value) > 0) if kind == "risk" else inside, F.col(value))
    values = F.array(*(F.struct(F.lit(out).alias("out"), F.when(inside, v.cast("double")).alias("v")) for out, (inside, v) in own.items()))
    long = df.select(*by, F.explode(values).alias("x")).select(*by, F.col("x.out").alias("__out"), F.col("x.v").alias("__value"))
    stats = long.groupBy(*by, "__out").agg(F.max("__value").alias("__top")).join(percentiles(long, F.col("__value"), {"__p99": 0.99}, [*by, "__out"]), [*by, "__out"], "left")
    only = lambda out, c: F.max(F.when(F.col("__out") == out, F.col(c))).alias(f"{c}_{out}")
    wide = stats.groupBy(*by).agg(*(only(out, c) for out in own for c in ("__top", "__p99")))
    full = beside(df, wide if by else sized(wide), by)
    p = NORMALISERS[kind]
    for out, (inside, v) in own.items():
        top = F.col(f"__top_{out}")
        scaled = F.coalesce(rescaled(v, p, F.when(top > 0, top), F.col(f"__p99_{out}")), F.lit(p.floor))
        full = full.withColumn(out, F.when(inside, scaled).otherwise(0.0)).drop(f"__top_{out}", f"__p99_{out}")
    return full


def normalise(df: DataFrame, value: str, kind: str, mask: Column, out: str = "normalised", by: list[str] | None = None) -> DataFrame:
    """One column of ``normalise_all``."""
    return normalise_all(df, kind, {out: (value, mask)}, by)


def conserve(df: DataFrame, value: str, target: DataFrame, total: str, by: list[str] | None = None, out: str = "conserved") -> DataFrame:
    """Spread what is missing from the target total over positive cells in proportion; nothing below 1e-6."""
    sums = df.groupBy(*(by or [])).agg(F.sum(F.when(F.col(value) > 0, F.col(value))).alias("__sum"))
    full = beside(beside(df, sums, by), target, by)
    rest = F.col(total) - F.col("__sum")
    spread = F.when((F.abs(rest) >= 1e-6) & (F.col(value) > 0), F.col(value) + rest * F.col(value) / F.col("__sum")).otherwise(F.col(value))
    return full.withColumn(out, spread).drop("__sum", total)
