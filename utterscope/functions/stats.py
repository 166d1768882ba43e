"""Exact order statistics that do not bring a group's values to one task.

Numbers become 64-bit keys of the same order, and the wanted ranks are found by descent over the keys' bits, 16 at a time from
the first: a step counts the values that share the bits found so far by their next 16 bits, so a rank's histogram has at most
65,536 rows whatever the values are, and the bucket that holds the rank gives the next bits. After four steps one key is left.
Values are counted before (with map-side sums); every step reads these counts.

The order is that of the numbers, with NaN after all of them; the two zeros are one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits that are left below a bucket's, step by step.
SHIFTS = (48, 32, 16, 0)


def sort_key(v: Column) -> Column:
    """A long that orders as the double does: exponent and fraction of the size, and the sign; NaN is last."""
    a = F.abs(v)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023)).cast("double")  # the logarithm may be off by one
    part = a / F.pow(F.lit(2.0), guess)
    power = guess + F.when(part >= 2, 1.0).when(part < 1, -1.0).otherwise(0.0)
    fraction = ((a / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("bigint")
    ordinary = (power.cast("bigint") + 1023) * (1 << 52) + fraction
    tiny = (a * 2.0**537 * 2.0**537).cast("bigint")
    size = F.when(a == 0, F.lit(0)).when(a < 2.0**-1022, tiny).when(a < float("inf"), ordinary).otherwise(F.lit(2047 << 52))
    return F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(v < 0, -size).otherwise(size).cast("bigint")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], names: Sequence[str]) -> Column:
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & a[k].eqNullSafe(b[n])
    return same


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, count, minimum, median, percentile_95 (nearest rank), mean and maximum of the non-null values of each group."""
    names = [f"__k{i}" for i in range(len(keys))]
    counts = (
        df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("__v"))
        .groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__key", sort_key(F.col("__v")))
    )
    asked = [f"__w{n}" for n in names]
    along, whole = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*names)
    total = F.col("count")
    ranks = {"__low": (total - 1 - (total - 1) % 2) / 2, "__high": (total - total % 2) / 2, "__p95": F.ceil(total * 95 / 100) - 1}
    first = (
        counts.groupBy(*names, F.shiftright("__key", SHIFTS[0]).alias("__bucket"))
        .agg(F.sum("__n").alias("__m"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.sum(F.col("__v") * F.col("__n")).alias("__sum"))
        .select(
            *names, "__bucket", "__m", F.sum("__m").over(along).alias("__upto"), F.sum("__m").over(whole).alias("count"), F.min("__min").over(whole).alias("minimum"),
            F.max("__max").over(whole).alias("maximum"), (F.sum("__sum").over(whole) / F.sum("__m").over(whole)).alias("mean"),
        )
    )
    every = F.array(*[F.struct(F.lit(r).alias("which"), x.cast("bigint").alias("rank")) for r, x in ranks.items()])
    here = F.filter(every, lambda w: (w["rank"] < F.col("__upto")) & (w["rank"] >= F.col("__upto") - F.col("__m")))
    of_group = ["count", "minimum", "maximum", "mean"]
    wanted = first.withColumn("w", F.explode(here)).select(
        *[F.col(n).alias(w) for n, w in zip(names, asked)], F.col("w.which").alias("__which"), (F.col("w.rank") - F.col("__upto") + F.col("__m")).alias("__rank"),
        F.col("__bucket").alias("__found"), *of_group,
    )
    for before, shift in zip(SHIFTS, SHIFTS[1:]):
        # null-safe as it must not become a filter on one use of the counts, which would then be made twice
        meets = _same(counts, wanted, names, asked) & F.shiftright("__key", before).eqNullSafe(F.col("__found"))
        histogram = (
            counts.join(wanted, meets).groupBy(*asked, "__which", "__rank", *of_group, F.shiftright("__key", shift).alias("__bucket"))
            .agg(F.sum("__n").alias("__m"), F.min("__v").alias("__value"))
        )
        along = Window.partitionBy(*asked, "__which").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
        below = F.col("__upto") - F.col("__m")
        wanted = (
            histogram.withColumn("__upto", F.sum("__m").over(along)).where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= below))
            .select(*asked, "__which", (F.col("__rank") - below).alias("__rank"), F.col("__bucket").alias("__found"), "__value", *of_group)
        )
    at = [F.max(F.when(F.col("__which") == r, F.col("__value"))).alias(r) for r in ranks]
    found = wanted.groupBy(*asked).agg(*[F.first(c).alias(c) for c in of_group], *at)
    return found.select(
        *[F.col(w).alias(k) for k, w in zip(keys, asked)], "count", "minimum", ((F.col("__low") + F.col("__high")) / 2).alias("median"),
        F.col("__p95").alias("percentile_95"), "mean", "maximum",
    )
