"""Seeded, reproducible orders for training: random, stratified, mixed scanners, epochs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rank import global_rank


def shuffle_key(*cols: str, seed: int = 0) -> Column:
    """A pseudo-random key that depends only on the values and the seed, so a re-run task gives the same order."""
    return F.xxhash64(*(F.col(c) for c in cols), F.lit(seed))


def random_order(groups: DataFrame, key: str, seed: int = 0, batch_size: int | None = None) -> DataFrame:
    """``groups`` with ``place`` 0..n-1 in a random order, and ``batch`` = place // batch_size if asked."""
    out = global_rank(groups, [shuffle_key(key, seed=seed), F.col(key)], "place")
    return out.withColumn("batch", F.floor(F.col("place") / batch_size).cast("bigint")) if batch_size else out


def stratified_order(groups: DataFrame, key: str, stratum: str, seed: int = 0) -> DataFrame:
    """``place``: strata take turns, each in its own random order; without the column, the random order.

    The turn is each row's rank inside its stratum; it is found with one range-partitioned ranking of all rows, so a
    stratum with most of the rows is spread over tasks.
    """
    if stratum not in groups.columns:
        return random_order(groups, key, seed)
    ranked = global_rank(groups, [F.col(stratum), shuffle_key(key, seed=seed), F.col(key)], "__all")
    first = ranked.groupBy(F.col(stratum).alias("__s")).agg(F.min("__all").alias("__first"))  # one row per stratum
    turns = ranked.join(first, ranked[stratum].eqNullSafe(first["__s"])).withColumn("turn", F.col("__all") - F.col("__first"))
    return global_rank(turns.drop("__s", "__first", "__all"), [F.col("turn"), F.col(stratum)], "place")


def mixed_scanner_order(rows: DataFrame, fragment: str, key: str, scanners: int = 16, chunk: int = 1024, seed: int = 0) -> DataFrame:
    """``place``: near-random order that reads fragments in chunks, about ``scanners`` fragments at a time.

    Every row comes once. Fragments get a random order; a round covers ``scanners`` of them; inside a round the
    chunks of its fragments alternate.
    """
    if not 1 <= scanners <= 100:
        raise ValueError("scanners must be within 1 and 100")
    local = global_rank(rows, [F.col(fragment), F.col(key)], "__all")
    sizes = local.groupBy(F.col(fragment).alias("__f")).agg(F.min("__all").alias("__first"))
    turn = global_rank(sizes, [F.xxhash64("__f", F.lit(seed))], "__turn")
    j = local.join(turn, local[fragment].eqNullSafe(turn["__f"]))
    j = j.withColumn("__round", F.floor(F.col("__turn") / scanners)).withColumn("__chunk", F.floor((F.col("__all") - F.col("__first")) / chunk))
    order = [F.col("__round"), F.col("__chunk"), F.xxhash64("__turn", "__chunk", F.lit(seed)), shuffle_key(key, seed=seed), F.col("__all")]
    return global_rank(j, order, "place").drop("__all", "__f", "__first", "__turn", "__round", "__chunk")


def epochs(groups: DataFrame, key: str, n_epochs: int, seed: int = 0) -> DataFrame:
    """Every row once per epoch, with ``epoch`` and ``place`` within it; epochs have different orders."""
    per = groups.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1)))).withColumn("__h", F.xxhash64(F.col(key), F.col("epoch"), F.lit(seed)))
    n = groups.count()
    ranked = global_rank(per, [F.col("epoch"), F.col("__h"), F.col(key)], "__all")
    return ranked.withColumn("place", F.col("__all") - F.col("epoch") * F.lit(n)).drop("__all", "__h")


def assign_partitions(n_partitions: int, n_workers: int, seed: int = 42) -> list[list[int]]:
    """Partitions dealt to workers: shuffled, then cut into runs; the first workers take the remainder."""
    if n_workers < 1:
        raise ValueError("at least one worker is needed")
    order = list(range(n_partitions))
    random.Random(seed).shuffle(order)
    base, extra = divmod(n_partitions, n_workers)
    out, at = [], 0
    for w in range(n_workers):
        size = base + (w < extra)
        out.append(order[at : at + size])
        at += size
    return out


def neighbour_distance(placed: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """Per batch the mean absolute difference of ``key`` between neighbours in it: small for sequential reading."""
    w = Window.partitionBy(batch).orderBy("place")
    d = placed.withColumn("__d", F.abs(F.col(key) - F.lag(key).over(w)))
    return d.groupBy(batch).agg(F.avg("__d").alias("mean_distance"), F.count(F.lit(1)).alias("n"))
