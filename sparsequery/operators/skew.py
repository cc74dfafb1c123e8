"""Two-stage salted aggregation for keys that hold a large part of all rows.

Heavy keys (at least ``heavy_share`` of all rows, so at most ``1 / heavy_share`` keys) get a salt; every aggregate
is computed per (key, salt) and the partials are merged per key. The salt is a hash of the row's other columns, not
``rand()``: it differs between the rows of a key, but a task that is run again after an executor was lost gives every row
the same salt. For distinct counts the salt hashes the counted column, so the distinct sets of two salts never overlap
and their sizes add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

SALT = "__sq_salt"


def heavy_keys(df: DataFrame, key: str, heavy_share: float = 0.01) -> DataFrame:
    """Keys with at least ``heavy_share`` of all rows: (key, __sq_rows). Null is a key like any other.

    Reads the key column once. The counts are combined on the map side, so a hot key costs one row per task in the
    shuffle; the total is the sum of the counts.
    """
    counts = stage(df.groupBy(key).agg(F.count(F.lit(1)).alias("__sq_rows")), "keycounts")
    total = counts.agg(F.sum("__sq_rows")).first()[0] or 0
    return counts.filter(F.col("__sq_rows") >= F.lit(heavy_share * total))


def salt_column(df: DataFrame, key: str, heavy: list, distinct: str | None, salts: int) -> Column:
    """0 for light keys; for heavy ones a number below ``salts`` from ``distinct``, else from all columns besides the key."""
    others = [distinct] if distinct else [c for c in df.columns if c != key] or [key]
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in others)), F.lit(salts)).cast("int")
    return F.when(_is_heavy(key, heavy), spread).otherwise(F.lit(0))


def _is_heavy(key: str, values: list) -> Column:
    known = [v for v in values if v is not None]
    cond = F.coalesce(F.col(key).isin(known), F.lit(False)) if known else F.lit(False)
    return (cond | F.col(key).isNull()) if None in values else cond


def salted_aggregate(
    df: DataFrame,
    key: str,
    value: str | None = None,
    distinct: str | None = None,
    heavy_share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """Per ``key``: ``n_rows`` and, if asked, ``n_distinct`` of ``distinct`` and statistics of ``value``.

    Statistics are over the usable values (not null, not NaN, above 0): ``n_usable``, ``sum_value``, ``min_value``,
    ``max_value``; they are null (``n_usable`` 0) for a key without one. Nulls in ``distinct`` are not counted. A null
    key is one group. An empty input gives an empty result. Without ``distinct``, all columns of ``df`` spread the rows of
    a heavy key over the salts, so leave out those that needn't be read; otherwise other columns are ignored.
    """
    if distinct:
        df = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(c for c in (key, value, distinct) if c)))
    heavy = [r[0] for r in heavy_keys(df, key, heavy_share).select(key).collect()]  # at most 1 / heavy_share rows
    salt = salt_column(df, key, heavy, distinct, salts)
    usable = None
    first = [F.count(F.lit(1)).alias("__sq_n")]
    if value:
        v = F.col(value).cast("double")
        usable = F.when(~F.isnan(v) & (v > 0), v)
        first += [F.count(usable).alias("__sq_u"), F.sum(usable).alias("__sq_s"), F.min(usable).alias("__sq_lo"), F.max(usable).alias("__sq_hi")]
    by = [key, SALT] + ([distinct] if distinct and distinct != key else [])
    part = df.withColumn(SALT, salt).groupBy(*by).agg(*first)  # partial per (key, salt[, distinct value])
    again = [F.sum("__sq_n").alias("__sq_n")]
    if value:
        again += [F.sum("__sq_u").alias("__sq_u"), F.sum("__sq_s").alias("__sq_s"), F.min("__sq_lo").alias("__sq_lo"), F.max("__sq_hi").alias("__sq_hi")]
    if distinct:
        part = part.groupBy(key, SALT).agg(*again, F.count(F.col(distinct)).alias("__sq_d"))
    merged = [F.sum("__sq_n").cast("bigint").alias("n_rows")]
    if distinct:
        merged.append(F.sum("__sq_d").cast("bigint").alias("n_distinct"))
    if value:
        merged += [F.sum("__sq_u").cast("bigint").alias("n_usable"), F.sum("__sq_s").alias("sum_value"), F.min("__sq_lo").alias("min_value"), F.max("__sq_hi").alias("max_value")]
    return part.groupBy(key).agg(*merged)


def frequent_keys(df: DataFrame, key: str, share: float, heavy_share: float = 0.01) -> DataFrame:
    """(key, n_rows) of the keys with at least ``share`` of all rows, by way of :func:`salted_aggregate`."""
    counts = stage(salted_aggregate(df, key, heavy_share=heavy_share), "counts")  # one row per key
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.filter(F.col("n_rows") >= F.lit(share * total)).select(key, "n_rows")
