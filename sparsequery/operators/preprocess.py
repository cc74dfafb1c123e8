"""Quality control, filters, normalisation and variability over the coordinate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

CELL, GENE, VALUE = "cell_integer_id", "gene_integer_id", "value"


def _ids(column: str, unique: bool) -> Column:
    """How many different ids; where every pair is stored once, a plain count, which needs one shuffle of partial sums less."""
    return F.count(column) if unique else F.countDistinct(column)


def cell_qc(expression: DataFrame, log1p: bool = True, unique: bool = False) -> DataFrame:
    """Per row id with stored entries: ``n_genes_by_counts``, ``total_counts`` (and their log1p).

    ``unique``: no pair is stored twice, as in a dataset's matrix.
    """
    v = F.col(VALUE).cast("double")
    q = expression.groupBy(CELL).agg(_ids(GENE, unique).alias("n_genes_by_counts"), F.sum(v).alias("total_counts"))
    if log1p:
        q = q.withColumns({"log1p_n_genes_by_counts": F.log1p("n_genes_by_counts"), "log1p_total_counts": F.log1p("total_counts")})
    return q


def gene_qc(expression: DataFrame, genes: DataFrame, log1p: bool = True, unique: bool = False) -> DataFrame:
    """Per column of ``genes``, those without entries included: ``n_cells_by_counts``, ``total_counts``."""
    v = F.col(VALUE).cast("double")
    a = expression.groupBy(F.col(GENE).alias("__g")).agg(_ids(CELL, unique).alias("n_cells_by_counts"), F.sum(v).alias("total_counts"))
    q = genes.select(GENE, F.coalesce("gene_id", F.concat(F.lit("gene_"), F.col(GENE).cast("string"))).alias("gene_id")).join(a, F.col(GENE) == F.col("__g"), "left").drop("__g")
    q = q.withColumns({"n_cells_by_counts": F.coalesce("n_cells_by_counts", F.lit(0)), "total_counts": F.coalesce("total_counts", F.lit(0.0))})
    if log1p:
        q = q.withColumns({"log1p_n_cells_by_counts": F.log1p("n_cells_by_counts"), "log1p_total_counts": F.log1p("total_counts")})
    return q


def prefix_flag(column: str, prefix: str) -> Column:
    """Whether a name starts with ``prefix`` (null stays null), as for the columns of one family."""
    return F.startswith(column, F.lit(prefix))


def _between(count: Column, lo, hi) -> list[Column]:
    return [c for c in (None if lo is None else count >= lo, None if hi is None else count <= hi) if c is not None]


def passing(expression: DataFrame, key: str, min_counts=None, max_counts=None, min_n=None, max_n=None, unique: bool = False) -> DataFrame:
    """(key) of the ids whose stored entries meet all bounds; an id without entries never passes."""
    other = GENE if key == CELL else CELL
    a = expression.groupBy(key).agg(F.sum(F.col(VALUE).cast("double")).alias("__t"), _ids(other, unique).alias("__n"))
    for c in _between(F.col("__t"), min_counts, max_counts) + _between(F.col("__n"), min_n, max_n):
        a = a.filter(c)
    return a.select(key)


def filter_cells(expression: DataFrame, min_counts=None, max_counts=None, min_genes=None, max_genes=None, unique: bool = False) -> DataFrame:
    """The entries of the rows that pass; raises ValueError if none does."""
    return _kept(expression, passing(expression, CELL, min_counts, max_counts, min_genes, max_genes, unique), CELL, "rows")


def filter_genes(expression: DataFrame, min_counts=None, max_counts=None, min_cells=None, max_cells=None, unique: bool = False) -> DataFrame:
    """The entries of the columns that pass; raises ValueError if none does."""
    return _kept(expression, passing(expression, GENE, min_counts, max_counts, min_cells, max_cells, unique), GENE, "columns")


def _kept(expression: DataFrame, keep: DataFrame, key: str, what: str) -> DataFrame:
    keep = stage(keep, "passing")  # looked at twice
    if keep.isEmpty():
        raise ValueError(f"all {what} were filtered out")
    return expression.join(keep, key, "left_semi")


def normalize_total(expression: DataFrame, target_sum: float | None = 1e4) -> DataFrame:
    """Entries scaled to a total of ``target_sum`` per row; rows with total 0 become 0.

    The totals are one row per cell and joined back: broadcast where they are small, so that the entries stay in place.
    """
    t = 1e4 if target_sum is None else float(target_sum)
    if t <= 0:
        raise ValueError("target_sum must be above 0")
    v = F.col(VALUE).cast("double")
    total = expression.groupBy(F.col(CELL).alias("__c")).agg(F.sum(v).alias("__t"))
    return expression.join(total, F.col(CELL) == F.col("__c")).withColumn(VALUE, F.coalesce(F.try_divide(v, F.col("__t")) * F.lit(t), F.lit(0.0))).drop("__c", "__t")


def log1p(expression: DataFrame) -> DataFrame:
    return expression.withColumn(VALUE, F.log1p(F.col(VALUE).cast("double")))


def _variance(v: Column) -> Column:
    """Sample variance; rounded only once for whole numbers whose squares add up exactly, so that bounds are met as they should be."""
    n, total, squares = F.count(v), F.sum(v), F.sum(v * v)
    exact = F.bool_and(v == F.rint(v)) & (squares <= F.lit(float(1 << 53))) & (n > 1)
    whole = "decimal(19,0)"  # products of two still fit a decimal
    spread = n.cast(whole) * squares.cast(whole) - total.cast(whole) * total.cast(whole)
    return F.when(exact, spread.cast("double") / (n.cast("double") * (n - 1).cast("double"))).otherwise(F.var_samp(v))


def highly_variable_genes(expression: DataFrame, genes: DataFrame, min_mean=0.0125, max_mean=3.0, min_disp=0.5, max_disp=float("inf"), n_top: int | None = None, unique: bool = False) -> DataFrame:
    """Per column: ``n_cells means variances dispersions highly_variable`` over stored entries (sample variance).

    Columns without entries are 0 throughout. With ``n_top`` the first by dispersion (then id) are marked instead.
    """
    v = F.col(VALUE).cast("double")
    a = expression.groupBy(F.col(GENE).alias("__g")).agg(_ids(CELL, unique).alias("n_cells"), F.avg(v).alias("means"), _variance(v).alias("variances"))
    h = genes.select(GENE).join(a, F.col(GENE) == F.col("__g"), "left").drop("__g")
    h = h.withColumns({"n_cells": F.coalesce("n_cells", F.lit(0)), "means": F.coalesce("means", F.lit(0.0)), "variances": F.coalesce("variances", F.lit(0.0))})
    h = h.withColumn("dispersions", F.when(F.col("means") > 0, F.col("variances") / F.col("means")).otherwise(0.0))
    if n_top is None:
        return h.withColumn("highly_variable", F.col("means").between(min_mean, max_mean) & F.col("dispersions").between(min_disp, max_disp))
    # top-k by a limited sort, then a join: no window over all columns in one task
    top = h.orderBy(F.desc("dispersions"), GENE).limit(n_top).select(F.col(GENE).alias("__t"))
    return h.join(top, F.col(GENE) == F.col("__t"), "left").withColumn("highly_variable", F.col("__t").isNotNull()).drop("__t")
