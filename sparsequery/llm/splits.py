"""Splits that keep related records together.

Components come from parallel hooking and shortcutting: every root hooks to its smallest neighbouring root, parent
pointers are then shortened until all trees are stars, and the edges are contracted to the roots. Whole components
are dealt to the splits by subset-sum bitsets over the multiplicities of their sizes.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_rank
from ..session import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; the component is its smallest node.

    Rows with a null end are left out; loops keep their node; repeated edges don't matter. Each round halves the
    roots at least (of two neighbouring roots one hooks), and only distinct edges between roots are kept.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null").distinct()
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    parent = stage(nodes.withColumn("p", F.col("node")), "parent")
    e = stage(e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while not e.isEmpty():
        # hooking: the edge list holds roots only, u < v
        hook = e.groupBy("v").agg(F.min("u").alias("to"))
        roots = stage(hook.select(F.col("v").alias("root"), "to"), "hooks")
        while True:  # shortcutting among the hooked roots
            up = roots.select(F.col("root").alias("r2"), F.col("to").alias("t2"))
            short = roots.join(up, roots["to"] == up["r2"], "left")
            moved = stage(short.select("root", F.coalesce("t2", "to").alias("to"), F.col("t2").isNotNull().alias("m")), "hooks")
            roots = moved.select("root", "to")
            if moved.filter("m").isEmpty():
                break
        parent = stage(parent.join(roots, parent["p"] == roots["root"], "left").select("node", F.coalesce("to", "p").alias("p")), "parent")
        ru, rv = roots.select(F.col("root").alias("ru"), F.col("to").alias("tu")), roots.select(F.col("root").alias("rv"), F.col("to").alias("tv"))
        moved = e.join(ru, e["u"] == ru["ru"], "left").join(rv, e["v"] == rv["rv"], "left").select(F.coalesce("tu", "u").alias("x"), F.coalesce("tv", "v").alias("y"))
        e = stage(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    return parent.select("node", F.col("p").alias("component"))


def tied_groups(rows: DataFrame, group: str, tie: str) -> DataFrame:
    """(node, component) of the non-null ``group`` values; two are tied if a non-null ``tie`` value occurs with both.

    Each tie value links its groups to the smallest of them: as many edges as distinct (group, tie) pairs, however
    many rows or groups a value holds.
    """
    pairs = rows.select(F.col(group).alias("g"), F.col(tie).alias("t")).filter("g is not null").distinct()
    pairs = stage(pairs, "pairs")
    first = pairs.filter("t is not null").groupBy("t").agg(F.min("g").alias("m"))
    linked = pairs.join(first, "t").select(F.col("g").alias("a"), F.col("m").alias("b"))
    alone = pairs.select(F.col("g").alias("a"), F.col("g").alias("b"))
    return components(linked.unionByName(alone))


def closest_subset(sizes: dict[int, int], target: int, resolution: int = 1 << 26) -> dict[int, int]:
    """How many of each size to take so that their total comes closest to ``target``.

    Exact for targets up to ``resolution``, the bits of a bitset. Beyond it the larger sizes are chosen in coarse units, to
    come near the target less half the total of the smaller sizes, which together have at most ``resolution`` records and, as
    far as there are such, reach every total up to that; what is missing is settled with them exactly. The result is off
    only if the larger sizes come no nearer than that half, or if the smaller sizes have gaps in their totals.
    """
    if target <= resolution:
        return _subset(sizes, target, 1)
    ordered = sorted(s for s in sizes if s > 0)
    small, room = {}, resolution
    for s in ordered:
        k = min(sizes[s], room // s)
        if not k or s > resolution - room + 1 and 1 in sizes:  # a larger one would leave gaps
            break
        small[s], room = k, room - s * k
    large = {s: n - small.get(s, 0) for s, n in sizes.items() if n > small.get(s, 0)}
    spare = sum(s * n for s, n in small.items())
    coarse = _subset(large, max(0, target - spare // 2), -(-target // resolution))
    gap = target - sum(s * n for s, n in coarse.items())
    while gap < 0:  # more than wanted: give back the smallest of the large
        s = min(s for s, n in coarse.items() if n)
        coarse[s], gap = coarse[s] - 1, gap + s
    fine = _subset(small, min(gap, spare), 1)
    return {s: coarse.get(s, 0) + fine.get(s, 0) for s in {*coarse, *fine}}


def _subset(sizes: dict[int, int], target: int, unit: int) -> dict[int, int]:
    """The choice by a bitset of reachable totals in units; multiplicities are split into powers of two.

    Bitsets are kept at every isqrt(m)-th item and rebuilt in between while tracing back.
    """
    goal = target // unit
    items = []
    for s in sorted((s for s in sizes if s > 0), reverse=True):
        left, k = sizes[s], 1
        while left:
            k = min(k, left)
            items.append(((s * k + unit // 2) // unit, s, k))
            left, k = left - k, k * 2
    if not items:
        return {}
    top = goal + max((w for w, _, _ in items), default=0)
    mask = (1 << (top + 1)) - 1
    step = max(1, isqrt(len(items)))
    kept, reach = [1], 1
    for i, (w, _, _) in enumerate(items):
        reach = (reach | reach << w) & mask
        if (i + 1) % step == 0:
            kept.append(reach)
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> (goal + 1)
    total = below
    if above:
        over = goal + 1 + (above & -above).bit_length() - 1
        total = over if over - goal < goal - below else below
    taken: dict[int, int] = {}
    for block in range((len(items) - 1) // step, -1, -1):
        part = items[block * step : (block + 1) * step]
        before = [kept[block]]
        for w, _, _ in part[:-1]:
            before.append((before[-1] | before[-1] << w) & mask)
        for (w, s, k), r in zip(reversed(part), reversed(before)):
            if not r >> total & 1:
                total -= w
                taken[s] = taken.get(s, 0) + k
    return taken


def assign_splits(members: DataFrame, targets: DataFrame) -> DataFrame:
    """``members`` (record, unit) plus ``split_name``: all records of a unit in one split, totals closest to the shares.

    The distinct unit sizes are at most sqrt(2 * records), so their multiplicities go to the driver; the units
    themselves are ranked by size without a single-task window. Shares are divided by their sum; null shares are 0.
    """
    units = members.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    ranked = stage(global_rank(units, [F.col("size"), F.col("unit")], "rank"), "units")
    counts = {r["size"]: r["n"] for r in ranked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = sorted((float(r["target_share"] or 0), r["split_name"]) for r in targets.select("split_name", "target_share").distinct().collect())
    if not shares:
        raise ValueError("no split is given")
    total, whole = sum(s * n for s, n in counts.items()), sum(s for s, _ in shares) or 1.0
    left, ranges, at = dict(counts), [], {}
    start = 0
    for s in sorted(counts):
        at[s], start = start, start + counts[s]
    for i, (share, name) in enumerate(shares):
        take = left if i == len(shares) - 1 else closest_subset(left, round(total * share / whole))
        for s, n in take.items():
            if n:
                ranges.append((s, at[s], at[s] + n, name))
                at[s] += n
        left = {s: n - take.get(s, 0) for s, n in left.items()} if take is not left else {}
    # at most (number of splits) rows per distinct size
    r = members.sparkSession.createDataFrame(ranges or [(0, 0, 0, "")], "s bigint, lo bigint, hi bigint, split_name string")
    dealt = ranked.join(F.broadcast(r), (ranked["size"] == r["s"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("unit", "split_name")
    return members.join(dealt, "unit")
