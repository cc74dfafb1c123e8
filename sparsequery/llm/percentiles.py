"""Exact percentiles per group by distributed multi-select, and summaries of separate loads that can be combined.

The values of a group that may still hold a wanted rank form disjoint ranges. Every partition proposes, of each range, the
median of its own values, the medians of the halves beside it, and so on for ``LEVELS`` levels; medians of the proposals,
weighted by the number of values behind them, are the range's pivots. All partitions count below, equal to and above
them. Ranks that fall on a pivot are found; a stretch between pivots without a wanted rank is discarded, and only the rest
is written for the next round, in which each stretch is a range of its own. This is repeated for all groups at once until
every rank is found. Whatever the number of groups, the state is in tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop, stage

LEVELS = 4  # 15 pivots a range, so a round leaves about a 16th of the values per rank
ACCURACY = 200  # of a partition's proposals, which only have to be values near its medians


def _proposals(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, ``n``, ``pivots``) of every range; a partition sends one row per range. Pivots ascend, without repeats."""
    points = F.array(*(F.lit(i / (1 << LEVELS)) for i in range(1, 1 << LEVELS)))
    local = rows.groupBy(*by, F.spark_partition_id().alias("part")).agg(F.percentile_approx("v", points, ACCURACY).alias("m"), F.count(F.lit(1)).alias("w"))
    each = local.select(*by, "w", F.posexplode("m").alias("i", "m"))
    merged = each.groupBy(*by).agg(F.sum(F.when(F.col("i") == 0, F.col("w"))).alias("n"), F.percentile("m", points, F.col("w")).alias("pivots"))
    # between minus and plus infinity the middle is not a number; any finite pivot parts them
    return merged.withColumn("pivots", F.array_sort(F.array_distinct(F.transform("pivots", lambda x: F.nanvl(x, F.lit(0.0)) + F.lit(0.0)))))


def multi_select(df: DataFrame, groups: list[str], value: str, ps: list[float], stats: dict | None = None) -> DataFrame:
    """(*groups, ``n``, ``p``, ``percentile``): exact percentiles with linear interpolation.

    Null and NaN values are left out, infinite ones are values; a null group is a group; a group without values has no
    row; an empty table gives an empty result. A group of any size costs a row per partition and range in a shuffle.
    ``stats`` gets the number of ``rounds`` and the ``rows`` that each of them read.
    """
    src = df.select(F.struct(*(F.col(c) for c in groups)).alias("g"), (F.col(value).cast("double") + F.lit(0.0)).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    values = stage(src, "values")
    # a range is named by r, a number of its own in each round; the first ranges are the whole groups
    sizes = stage(_proposals(values, "g").withColumn("r", F.monotonically_increasing_id()), "groups")
    at = F.lit(1.0) * (F.col("n") - 1) * F.col("p")
    low = F.floor(at).cast("bigint")
    asked = sizes.select("g", "n", "r", F.explode(F.array(*(F.lit(float(p)) for p in ps))).alias("p")).select("g", "n", "r", "p", low.alias("lo"), F.least(low + 1, F.col("n") - 1).alias("hi"), (at - low).alias("part"))
    wanted = asked.select(F.col("r").alias("g0"), F.explode(F.array("lo", "hi")).alias("k0"), "r").distinct().withColumn("k", F.col("k0"))
    live = sizes.select("r", "pivots")
    data = values.join(sizes.select(F.col("g").alias("g2"), "r"), F.col("g") == F.col("g2")).select("r", "v")
    found, before = [], values
    while True:
        data = stage(data, "ranges")
        drop(before)
        before = data
        # even sides lie between pivots, odd ones on a pivot
        side = 2 * F.size(F.filter("pivots", lambda x: x < F.col("v"))) + F.array_contains("pivots", F.col("v")).cast("int")
        split = data.join(live.select(F.col("r").alias("r1"), "pivots"), F.col("r") == F.col("r1")).select("r", side.alias("side"), "v")
        order = Window.partitionBy("r").orderBy("side")  # at most two sides per pivot, and one
        sides = _proposals(split, "r", "side").withColumn("upto", F.sum("n").over(order))
        sides = stage(sides.withColumn("next", F.monotonically_increasing_id()), "sides")
        s = sides.select(F.col("r").alias("r1"), "side", "n", "upto", "pivots", "next")
        hit = (F.col("r") == F.col("r1")) & (F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n"))
        moved = wanted.join(s, hit).select("g0", "k0", F.col("next").alias("r"), (F.col("k") - F.col("upto") + F.col("n")).alias("k"), (F.col("side") % 2 == 1).alias("here"), F.col("pivots")[0].alias("x"))
        moved = stage(moved, "ranks")
        found.append(moved.filter("here").select("g0", "k0", "x"))
        if stats is not None:
            stats["rounds"] = stats.get("rounds", 0) + 1
            stats.setdefault("rows", []).append(data.count())
        wanted = moved.filter("not here").select("g0", "k0", "r", "k")
        if wanted.isEmpty():
            break
        going = wanted.select(F.col("r").alias("next")).distinct()
        live = sides.join(going, "next").select(F.col("next").alias("r"), "pivots")
        names = sides.join(going, "next").select(F.col("r").alias("r1"), F.col("side").alias("s1"), "next")
        data = split.join(names, (F.col("r") == F.col("r1")) & (F.col("side") == F.col("s1"))).select(F.col("next").alias("r"), "v")
    drop(before)
    at_rank = stage(reduce(DataFrame.unionByName, found), "found")
    a, b = (at_rank.select(*(F.col(c).alias(c + s) for c in ("g0", "k0", "x"))) for s in "ab")
    out = asked.join(a, (F.col("r") == F.col("g0a")) & (F.col("lo") == F.col("k0a"))).join(b, (F.col("r") == F.col("g0b")) & (F.col("hi") == F.col("k0b")))
    between = F.when((F.col("part") == 0) | (F.col("xa") == F.col("xb")), F.col("xa")).otherwise(F.col("xa") + (F.col("xb") - F.col("xa")) * F.col("part"))
    return out.select(*(F.col("g")[c].alias(c) for c in groups), "n", "p", between.alias("percentile"))


def summarize(df: DataFrame, load: str, groups: list[str], value: str, points: int = 64) -> DataFrame:
    """Per load and group ``n`` and ``points`` values at evenly spaced ranks, found by multi-select.

    Each value stands for n / points neighbouring ranks and lies within half as many of all of them.
    """
    ps = [(i + 0.5) / points for i in range(points)]
    return multi_select(df, [load, *groups], value, ps).select(load, *groups, "n", "p", F.col("percentile").alias("v"), (F.col("n") / F.lit(points)).alias("w"))


def combine(summaries: DataFrame, groups: list[str], ps: list[float]) -> DataFrame:
    """(*groups, n, p, percentile) over all loads; the rank is off by at most n / points plus one per load."""
    s = summaries.withColumn("upto", F.sum("w").over(Window.partitionBy(*groups).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("all", F.sum("w").over(Window.partitionBy(*groups)))
    out = s.groupBy(*groups).agg(F.round(F.max("all")).cast("bigint").alias("n"), *(F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("v"))).alias(f"q{i}") for i, p in enumerate(ps)))
    return out.select(*groups, "n", F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("percentile")) for i, p in enumerate(ps)))).alias("q")).select(*groups, "n", "q.p", "q.percentile")
