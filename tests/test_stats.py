import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from utterscope.functions.stats import distribution


def test_known(spark):
    row = distribution(spark.createDataFrame([("k", v) for v in (1.0, 2.0, 3.0, 4.0)], "k string, v double"), ["k"], "v").first()
    assert (row["count"], row["minimum"], row["median"], row["percentile_95"], row["maximum"]) == (4, 1.0, 2.5, 4.0, 4.0)


def test_random_groups_with_nulls_and_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 5.0, rng.uniform(-60, 60), rng.randint(0, 3) / 4])) for _ in range(3000)] + [("one", 7.5), ("none", None)]
    got = {r["k"]: r for r in distribution(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        values = sorted(v for key, v in rows if key == k and v is not None)
        assert r["count"] == len(values) and r["minimum"] == values[0] and r["maximum"] == values[-1]
        assert r["median"] == statistics.median(values)
        assert r["percentile_95"] == values[-(-95 * len(values) // 100) - 1]
        assert r["mean"] == pytest.approx(statistics.fmean(values))


def test_empty(spark):
    assert distribution(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_nan_and_zeros_and_infinities_have_their_place(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from utterscope.functions.stats import distribution, sort_key

    inf, nan = float("inf"), float("nan")
    row = distribution(spark.createDataFrame([("a", x) for x in (3.0, nan, 1.0, 2.0)], "k string, v double"), ["k"], "v").first()
    assert row["median"] == 2.5 and math.isnan(row["percentile_95"]) and math.isnan(row["maximum"]) and row["minimum"] == 1.0
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e300), rng.gauss(0, 5e-324), float(rng.randint(-9, 9)), 2.0 ** rng.randint(-1074, 1023), math.nextafter(2.0 ** rng.randint(-900, 900), 0)]) for _ in range(4000)]
    values += [0.0, -0.0, inf, -inf, nan, 5e-324, -5e-324, 1.7976931348623157e308]
    keys = {r["v"]: r["c"] for r in spark.createDataFrame([(x,) for x in values], "v double").select("v", sort_key(F.col("v")).alias("c")).collect()}
    bits = lambda x: struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    assert all(key == (bits(x) if x >= 0 else -bits(x)) for x, key in keys.items() if x == x)
    assert [k for x, k in keys.items() if x != x] == [bits(inf) + 1]
    for own in (values, [x for x in values if x == x], [-0.0, 0.0, 0.0], [inf, -inf], [7.0]):
        got = distribution(spark.createDataFrame([(x,) for x in own], "v double").withColumn("k", F.lit(1)), ["k"], "v").first()
        ordered = sorted(own, key=lambda x: (x != x, x))
        n = len(ordered)
        same = lambda a, b: a == b or (a != a and b != b)
        assert same(got["median"], (ordered[(n - 1) // 2] + ordered[n // 2]) / 2) and same(got["percentile_95"], ordered[math.ceil(0.95 * n) - 1])


def test_a_group_of_many_values_in_one_unit(spark):
    from pyspark.sql import functions as F

    from utterscope.functions.stats import distribution

    df = spark.range(1_000_000).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % 1_000_003 / 1_000_003).alias("v"))
    values = sorted(i * 7919 % 1_000_003 / 1_000_003 for i in range(1_000_000))
    row = distribution(df, ["k"], "v").first()
    assert row["median"] == (values[499_999] + values[500_000]) / 2 and row["percentile_95"] == values[949_999] and row["count"] == 1_000_000


def test_timestamps_of_a_day_take_bounded_histograms(spark):
    from utterscope.functions import stats

    base, n = 1.7e15, 400_000
    df = spark.range(n).select(F.lit("day").alias("k"), (F.lit(base) + F.col("id") * 43_201 % 86_400_000_000).alias("v"))
    values = sorted(base + i * 43_201 % 86_400_000_000 for i in range(n))
    row = stats.distribution(df, ["k"], "v").first()
    assert row["median"] == (values[n // 2 - 1] + values[n // 2]) / 2 and row["percentile_95"] == values[n * 95 // 100 - 1]
    for before, shift in zip((64, *stats.SHIFTS), stats.SHIFTS):  # what a step's window sees
        key = stats.sort_key(F.col("v"))
        prefix = F.shiftright(key, before) if before < 64 else F.lit(0)
        most = df.groupBy(prefix.alias("p")).agg(F.count_distinct(F.shiftright(key, shift)).alias("n")).agg(F.max("n")).first()[0]
        assert most <= 65_536
