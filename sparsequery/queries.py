"""Query registry of the core: each entry is a Spark function and the SQL it equals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cli import limited
from .dataset import Dataset
from .functions import tokens as tk
from .operators import batches, preprocess, shuffle, skew, windows
from .operators.rank import global_rank
from .session import scratch_path
from .sources import ingest, layout, partitioned
from .streaming import groups as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CELL, GENE, VALUE = "cell_integer_id", "gene_integer_id", "value"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# The tables as a dataset: one row per cell and gene, the current usable value of every pair.
PRE = """WITH c AS (SELECT cell_integer_id, cell_id, cell_type, lower(trim(batch)) AS batch, donor, CASE WHEN total_counts > 0 AND NOT isnan(total_counts) THEN CAST(total_counts AS DOUBLE) END AS total_counts,
    CAST(n_genes_by_counts AS BIGINT) AS n_genes_by_counts, high_mito, source_file
    FROM (SELECT *, row_number() OVER (PARTITION BY cell_integer_id ORDER BY loaded_at DESC NULLS LAST) k FROM cells) WHERE k = 1),
  g AS (SELECT gene_integer_id, max(gene_id) AS gene_id, max(gene_symbol) AS gene_symbol, max(gene_type) AS gene_type, max(highly_variable) AS highly_variable FROM genes GROUP BY 1),
  e AS (SELECT cell_integer_id, gene_integer_id, value FROM (SELECT *, row_number() OVER (PARTITION BY cell_integer_id, gene_integer_id ORDER BY loaded_at DESC NULLS LAST, value DESC) k
    FROM expression WHERE value IS NOT NULL AND NOT isnan(value) AND value > 0) WHERE k = 1),
  n AS (SELECT (SELECT max(cell_integer_id) + 1 FROM c) AS nc, (SELECT max(gene_integer_id) + 1 FROM g) AS ng)"""


def raw_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The delivered tables as those of a dataset: each cell's latest row, each pair's current usable value."""
    cells = table(spark, d, "cells")
    latest = cells.groupBy(CELL).agg(F.max(F.struct("loaded_at", "cell_id", "cell_type", F.lower(F.trim("batch")).alias("batch"), "donor", "total_counts", "n_genes_by_counts", "high_mito", "source_file")).alias("x"))
    t = F.col("x.total_counts").cast("double")
    cells = latest.select(CELL, "x.cell_id", "x.cell_type", "x.batch", "x.donor", F.when((t > 0) & ~F.isnan(t), t).alias("total_counts"), F.col("x.n_genes_by_counts").cast("bigint").alias("n_genes_by_counts"), "x.high_mito", "x.source_file")
    genes = table(spark, d, "genes").groupBy(GENE).agg(*(F.max(c).alias(c) for c in ("gene_id", "gene_symbol", "gene_type", "highly_variable")))
    v = F.col(VALUE).cast("double")
    e = table(spark, d, "expression").filter(v.isNotNull() & ~F.isnan(v) & (v > 0)).groupBy(CELL, GENE).agg(F.max(F.struct("loaded_at", v.alias(VALUE))).alias("x")).select(CELL, GENE, F.col("x.value").alias(VALUE))
    return {"cells": cells, "genes": genes, "expression": e, "layers": table(spark, d, "layers"), "cellsxcells": table(spark, d, "cellsxcells")}


_OPENED: dict[tuple, Dataset] = {}


def dataset(spark: SparkSession, d: str) -> Dataset:
    """The delivered tables of folder ``d`` as an open dataset.

    They are ingested once per session (cleaned, clustered by cell and by gene) into a dataset folder in the shared
    folder, and again if a file has changed; queries then read what their predicates leave of it. Each call gives an
    object of its own over the stored tables, so that columns added to one are not seen by another.
    """
    key = (spark.sparkContext.applicationId, d, *(layout.stamp(spark, f"{d}/{n}.parquet") for n in ("cells", "genes", "expression", "layers", "cellsxcells")))
    ds = _OPENED.get(key)
    if ds is None or not layout.exists(spark, f"{ds.folder}/config.json"):
        folder = scratch_path(spark, "dataset")
        ingest.write_dataset(raw_tables(spark, d), folder, values="double")
        ds = _OPENED[key] = Dataset.open(spark, folder)
        ds.tables["cells"] = ds.cells.drop("cell_start_index")
    return Dataset(spark, dict(ds.tables), ds.shape)


NUDGE = 3e-9  # moves decimal ties off the rounding edge, where engines that sum in another order would part


def nudged(text: str) -> str:
    """``text`` with NUDGE added to whatever it rounds to 4 or 6 digits."""
    return text.replace(", 6)", f" + {NUDGE}, 6)").replace(", 4)", f" + {NUDGE}, 4)")


def query(sql: str | None = None, pre: bool = True):
    """Register a function; ``sql`` follows the prelude unless ``pre`` is off."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = f"{PRE}{'' if sql.startswith(',') else chr(10)}{sql}" if pre else sql
            SQL[f.__name__] = nudged(text)
        return f

    return add


def on(f):
    """A query that takes the dataset."""

    def run(spark, d):
        return f(dataset(spark, d))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def rnd(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    """Rounded columns, nudged like the SQL."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE if n < 9 else F.col(c), n) for c in cols})


def joined(df: DataFrame, *cols: str) -> DataFrame:
    """Array columns as comma-joined text."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in cols})


# keys that hold most records


@query("SELECT gene_integer_id FROM expression GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM expression)", pre=False)
def p4_found(spark, d):
    """Genes with at least 2 % of all stored rows."""
    return skew.frequent_keys(table(spark, d, "expression").select(GENE, CELL), GENE, 0.02).select(GENE)


P4 = """SELECT {0}, count(*) n_rows, count(DISTINCT {1}) n_distinct, count(u) n_usable, round(sum(u), 4) sum_value, min(u) min_value, max(u) max_value
  FROM (SELECT *, CASE WHEN value > 0 AND NOT isnan(value) THEN value END u FROM expression) GROUP BY 1"""


@query(P4.format(GENE, CELL), pre=False)
def p4_genes(spark, d):
    """Rows, distinct cells and statistics per gene."""
    return rnd(skew.salted_aggregate(table(spark, d, "expression"), GENE, VALUE, CELL), "sum_value", n=4)


@query(P4.format(CELL, GENE), pre=False)
def p4_cells(spark, d):
    """Rows, distinct genes and statistics per cell."""
    return rnd(skew.salted_aggregate(table(spark, d, "expression"), CELL, VALUE, GENE), "sum_value", n=4)


# scans and filters


@query("SELECT 'cells' AS name, count(*) AS n FROM c UNION ALL SELECT 'genes', count(*) FROM g UNION ALL SELECT 'expression', count(*) FROM e")
@on
def scan_tables(ds):
    return reduce(DataFrame.unionByName, [ds.tables[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("cells", "genes", "expression")])


@query("SELECT * FROM e")
@on
def scan_expression(ds):
    return ds.expression


SHOW = ["cell_integer_id", "cell_id", "batch", "total_counts", "n_genes_by_counts"]
SHOWN = ", ".join(SHOW)


@query(f"SELECT {SHOWN} FROM c WHERE batch = 'batch_1'")
@on
def filter_eq(ds):
    return ds.filter_cells(batch="batch_1").select(*SHOW)


@query(f"SELECT {SHOWN} FROM c WHERE cell_type IN ('T-cell', 'B-cell')")
@on
def filter_in(ds):
    return ds.filter_cells(cell_type=["T-cell", "B-cell"]).select(*SHOW)


@query(f"SELECT {SHOWN} FROM c WHERE total_counts >= 5000")
@on
def filter_range(ds):
    return ds.filter_cells(total_counts=">=5000").select(*SHOW)


@query(f"SELECT {SHOWN} FROM c")
@on
def filter_none(ds):
    return ds.filter_cells().select(*SHOW)


@query(f"SELECT {SHOWN} FROM c WHERE total_counts < 8000 AND n_genes_by_counts > 900 AND high_mito = false")
@on
def filter_cells_multi(ds):
    return ds.filter_cells(total_counts="<8000", n_genes_by_counts=">900", high_mito=False).select(*SHOW)


@query("SELECT gene_integer_id, gene_id, gene_type FROM g WHERE gene_integer_id >= 100 AND highly_variable = true")
@on
def filter_genes_range(ds):
    return ds.filter_genes(gene_integer_id=">=100", highly_variable=True).select(GENE, "gene_id", "gene_type")


NAMED = "SELECT cell_id, gene_id, value FROM e LEFT JOIN c USING (cell_integer_id) LEFT JOIN g USING (gene_integer_id)"


@query(f"{NAMED} WHERE cell_integer_id IN (3, 10, 77)")
@on
def cell_expression(ds):
    return ds.cell_expression([3, 10, 77])


@query(f"{NAMED} WHERE gene_integer_id IN (5, 6, 100)")
@on
def gene_expression(ds):
    return ds.gene_expression([5, 6, 100])


INDEX = "i AS (SELECT cell_integer_id, coalesce(k, 0) AS n_rows, CAST(sum(coalesce(k, 0)) OVER (ORDER BY cell_integer_id) - coalesce(k, 0) AS BIGINT) AS cell_start_index FROM c LEFT JOIN (SELECT cell_integer_id, count(*) k FROM e GROUP BY 1) USING (cell_integer_id))"


@query(f", {INDEX} SELECT * FROM i")
@on
def cell_start_index(ds):
    return layout.start_index(ds.expression, ds.cells)


@query(f", {INDEX} SELECT cell_integer_id, cell_start_index AS start, cell_start_index + n_rows AS stop FROM i WHERE cell_integer_id >= 50 AND cell_integer_id < 90")
@on
def row_ranges(ds):
    return ds.row_ranges(slice(50, 90))


# submatrices


def _sub(name: str, key, cond: str):
    def run(spark, d):
        return dataset(spark, d).X[key].df()

    run.__name__ = name
    query(f"SELECT e.* FROM e, n WHERE {cond}")(run)


_sub("submatrix_all", (None, None), "true")
_sub("submatrix_point", (7, None), "cell_integer_id = 7")
_sub("submatrix_slice", (slice(100, 400), slice(50, 300)), "cell_integer_id BETWEEN 100 AND 399 AND gene_integer_id BETWEEN 50 AND 299")
_sub("submatrix_step", (slice(0, 900, 3), slice(10, None, 7)), "cell_integer_id < 900 AND cell_integer_id % 3 = 0 AND gene_integer_id >= 10 AND (gene_integer_id - 10) % 7 = 0")
_sub("submatrix_negative", (slice(-200, None), slice(None, -100)), "cell_integer_id >= nc - 200 AND gene_integer_id < ng - 100")
_sub("submatrix_list", ([4, 9, 9, 120, -1], slice(None)), "cell_integer_id IN (4, 9, 120, nc - 1)")


@query(f"{NAMED} WHERE cell_integer_id < 60 AND gene_integer_id BETWEEN 200 AND 599")
@on
def submatrix_named(ds):
    return ds.submatrix(slice(None, 60), slice(200, 600))


@query(", p AS (SELECT * FROM (VALUES (0, 9), (1, 4), (2, 9), (3, 200)) t(row_pos, r)) SELECT CAST(row_pos AS BIGINT) AS row_pos, CAST(gene_integer_id - 100 AS BIGINT) AS col_pos, value FROM e JOIN p ON r = cell_integer_id WHERE gene_integer_id BETWEEN 100 AND 499")
@on
def submatrix_positions(ds):
    return ds.X[[9, 4, 9, 200], 100:500].positions()


@query("SELECT * FROM e WHERE cell_integer_id BETWEEN 110 AND 190 AND (cell_integer_id - 110) % 4 = 0 AND gene_integer_id BETWEEN 30 AND 49")
@on
def chained_slice(ds):
    return ds.X[100:500:2, 20:][5:46:2, 10:30].df()


@query(f"SELECT cell_integer_id, count(*) AS n, round(sum(value), 6) AS total FROM e JOIN c USING (cell_integer_id) WHERE batch = 'batch_2' GROUP BY 1")
@on
def subset_obs_mask(ds):
    """Counts and totals of the rows of a view chosen by metadata."""
    m = ds.view().where_cells(batch="batch_2").X.df()
    return rnd(m.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.sum(VALUE).alias("total")), "total")


@query("SELECT cell_integer_id, gene_integer_id, spliced AS value FROM layers WHERE spliced IS NOT NULL AND cell_integer_id < 500 AND gene_integer_id < 700", pre=False)
@on
def layer_submatrix(ds):
    return ds.matrix("spliced")[:500, :700].df()


@query("SELECT * FROM e WHERE cell_integer_id IN (1, 2, 3, 50, 51) UNION ALL SELECT * FROM e WHERE cell_integer_id BETWEEN 400 AND 420")
@on
def idset_union_all(ds):
    return ds.X[[1, 2, 3, 50, 51, *range(400, 421)]].df()


@query("SELECT min(cell_integer_id) AS first, max(cell_integer_id) AS last, count(*) AS n FROM (SELECT cell_integer_id, cell_integer_id - row_number() OVER (PARTITION BY batch ORDER BY cell_integer_id) AS k, batch FROM c WHERE batch IS NOT NULL) GROUP BY batch, k")
@on
def id_islands(ds):
    """Runs of consecutive ids inside each batch."""
    return windows.islands(ds.cells.filter("batch is not null"), CELL, "batch").select("first", "last", "n")


@query("SELECT cell_id, cell_type, batch, donor, total_counts, n_genes_by_counts, high_mito, source_file FROM c")
@on
def obs_view(ds):
    return ds.obs


@query("SELECT cell_integer_id, string_agg(CAST(CAST(coalesce(v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY gene_integer_id) AS row FROM (SELECT x.cell_integer_id, y.gene_integer_id, floor(e.value) AS v FROM (SELECT cell_integer_id FROM c WHERE cell_integer_id < 40) x CROSS JOIN (SELECT gene_integer_id FROM g WHERE gene_integer_id < 60) y LEFT JOIN e USING (cell_integer_id, gene_integer_id)) GROUP BY 1")
@on
def dense_rows(ds):
    return ds.X[:40, :60].dense_rows().select(CELL, F.array_join(F.transform("row", lambda x: F.floor(x).cast("string")), ",").alias("row"))


@query("SELECT cell_integer_id, string_agg(CAST(CAST(coalesce(v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY gene_integer_id) AS row FROM (SELECT x.cell_integer_id, y.gene_integer_id, floor(e.value) AS v FROM c x CROSS JOIN g y LEFT JOIN e USING (cell_integer_id, gene_integer_id)) GROUP BY 1")
@on
def whole_dense_rows(ds):
    """Dense rows of all cells and genes; dense_rows is a slice."""
    return ds.X.dense_rows().select(CELL, F.array_join(F.transform("row", lambda x: F.floor(x).cast("string")), ",").alias("row"))


# reductions with implicit zeros

VIEW0, VIEW1 = (slice(0, 2000), slice(None)), (slice(None), slice(0, 800))
AXIS = {
    0: ("gene_integer_id", "g", "2000.0", "cell_integer_id < 2000", VIEW0),
    1: ("cell_integer_id", "c", "800.0", "gene_integer_id < 800", VIEW1),
}
FORMULA = {
    "sum": "coalesce(s, 0)",
    "mean": "coalesce(s, 0) / {n}",
    "var": "greatest(coalesce(q, 0) / {n} - power(coalesce(s, 0) / {n}, 2), 0)",
    "std": "sqrt(greatest(coalesce(q, 0) / {n} - power(coalesce(s, 0) / {n}, 2), 0))",
    "max": "coalesce(hi, 0)",
    "min": "coalesce(lo, 0)",
    "count": "CAST(coalesce(k, 0) AS DOUBLE)",
}
PARTS = "sum(value) s, sum(value * value) q, max(value) hi, min(value) lo, count(*) k"


def _reduction(op: str, axis: int | None):
    def run(spark, d):
        ds = dataset(spark, d)
        if axis is None:
            return rnd(ds.X[:2000, :800].reduce(op, axis=None), op)
        return rnd(ds.X[AXIS[axis][4]].reduce(op, axis=axis), op)

    run.__name__ = f"matrix_{op}_{'all' if axis is None else f'axis{axis}'}"
    if axis is None:
        sql = f"SELECT round({FORMULA[op].format(n='1600000.0')}, 6) AS {op} FROM (SELECT {PARTS} FROM e WHERE cell_integer_id < 2000 AND gene_integer_id < 800)"
    else:
        key, dim, n, cond, _ = AXIS[axis]
        rng = f"(SELECT {key} FROM {dim})"
        sql = f"SELECT {key}, round({FORMULA[op].format(n=n)}, 6) AS {op} FROM {rng} d LEFT JOIN (SELECT {key}, {PARTS} FROM e WHERE {cond} GROUP BY 1) x USING ({key})"
    query(sql)(run)


for _op in ("sum", "mean", "var", "std"):
    for _axis in (0, 1) if _op == "std" else (0, 1, None):
        _reduction(_op, _axis)
_reduction("max", 0)
_reduction("min", 1)
_reduction("count", 0)


@query("SELECT gene_integer_id, round(coalesce(s, 0), 6) AS sum, round(coalesce(s, 0) / 2000.0, 6) AS mean, coalesce(hi, 0) AS max, CAST(coalesce(k, 0) AS DOUBLE) AS count FROM g LEFT JOIN (SELECT gene_integer_id, sum(value) s, max(value) hi, count(*) k FROM e WHERE cell_integer_id < 2000 GROUP BY 1) USING (gene_integer_id)")
@on
def multi_agg_axis0(ds):
    return rnd(ds.X[VIEW0].reduce("sum", "mean", "max", "count", axis=0), "sum", "mean")


# the same over whole tables; those above are reductions of slices


def _whole_reduction(op: str, axis: int | None):
    def run(spark, d):
        return rnd(dataset(spark, d).X.reduce(op, axis=axis), op)

    run.__name__ = f"whole_{op}_{'all' if axis is None else f'axis{axis}'}"
    if axis is None:
        sql = f"SELECT round({FORMULA[op].format(n='(CAST(nc AS DOUBLE) * ng)')}, 6) AS {op} FROM (SELECT {PARTS} FROM e), n"
    else:
        key, dim, n = (GENE, "g", "CAST(nc AS DOUBLE)") if axis == 0 else (CELL, "c", "CAST(ng AS DOUBLE)")
        sql = f"SELECT {key}, round({FORMULA[op].format(n=n)}, 6) AS {op} FROM {dim} LEFT JOIN (SELECT {key}, {PARTS} FROM e GROUP BY 1) x USING ({key}), n"
    query(sql)(run)


for _op in ("sum", "mean", "var", "std"):
    for _axis in (0, 1) if _op == "std" else (0, 1, None):
        _whole_reduction(_op, _axis)
_whole_reduction("max", 0)
_whole_reduction("min", 1)
_whole_reduction("count", 0)


@query("SELECT gene_integer_id, round(coalesce(s, 0), 6) AS sum, round(coalesce(s, 0) / CAST(nc AS DOUBLE), 6) AS mean, coalesce(hi, 0) AS max, CAST(coalesce(k, 0) AS DOUBLE) AS count FROM g LEFT JOIN (SELECT gene_integer_id, sum(value) s, max(value) hi, count(*) k FROM e GROUP BY 1) USING (gene_integer_id), n")
@on
def whole_multi_agg_axis0(ds):
    return rnd(ds.X.reduce("sum", "mean", "max", "count", axis=0), "sum", "mean")


# quality control, filters, transforms


@query("SELECT cell_integer_id, count(DISTINCT gene_integer_id) AS n_genes_by_counts, round(sum(value), 6) AS total_counts, round(ln(1 + count(DISTINCT gene_integer_id)), 6) AS log1p_n_genes_by_counts, round(ln(1 + sum(value)), 6) AS log1p_total_counts FROM e GROUP BY 1")
@on
def cell_qc(ds):
    return rnd(preprocess.cell_qc(ds.expression, unique=True), "total_counts", "log1p_n_genes_by_counts", "log1p_total_counts")


@query("SELECT gene_integer_id, gene_id, coalesce(k, 0) AS n_cells_by_counts, round(coalesce(s, 0), 6) AS total_counts, round(ln(1 + coalesce(k, 0)), 6) AS log1p_n_cells_by_counts, round(ln(1 + coalesce(s, 0)), 6) AS log1p_total_counts FROM g LEFT JOIN (SELECT gene_integer_id, count(DISTINCT cell_integer_id) k, sum(value) s FROM e GROUP BY 1) USING (gene_integer_id)")
@on
def gene_qc(ds):
    return rnd(preprocess.gene_qc(ds.expression, ds.genes, unique=True), "total_counts", "log1p_n_cells_by_counts", "log1p_total_counts")


@query("SELECT * FROM e WHERE cell_integer_id IN (SELECT cell_integer_id FROM e GROUP BY 1 HAVING count(DISTINCT gene_integer_id) >= 20 AND sum(value) <= 2000)")
@on
def pp_filter_cells(ds):
    return preprocess.filter_cells(ds.expression, min_genes=20, max_counts=2000, unique=True).select(CELL, GENE, VALUE)


@query("SELECT * FROM e WHERE gene_integer_id IN (SELECT gene_integer_id FROM e GROUP BY 1 HAVING count(DISTINCT cell_integer_id) >= 10 AND sum(value) >= 50)")
@on
def pp_filter_genes(ds):
    return preprocess.filter_genes(ds.expression, min_cells=10, min_counts=50, unique=True).select(CELL, GENE, VALUE)


HVG = "h AS (SELECT gene_integer_id, coalesce(k, 0) AS n_cells, coalesce(m, 0) AS means, coalesce(v, 0) AS variances, CASE WHEN coalesce(m, 0) > 0 THEN coalesce(v, 0) / m ELSE 0 END AS dispersions FROM g LEFT JOIN (SELECT gene_integer_id, count(DISTINCT cell_integer_id) k, avg(value) m, var_samp(value) v FROM e GROUP BY 1) USING (gene_integer_id))"


@query(f", {HVG} SELECT gene_integer_id, n_cells, round(means, 6) AS means, round(variances, 6) AS variances, round(dispersions, 6) AS dispersions, means BETWEEN 0.0125 AND 3 AND dispersions >= 0.5 AS highly_variable FROM h")
@on
def hvg(ds):
    return rnd(preprocess.highly_variable_genes(ds.expression, ds.genes, unique=True), "means", "variances", "dispersions")


@query(f", {HVG} SELECT gene_integer_id, row_number() OVER (ORDER BY dispersions DESC, gene_integer_id) <= 50 AS highly_variable FROM h")
@on
def hvg_top_n(ds):
    return preprocess.highly_variable_genes(ds.expression, ds.genes, n_top=50, unique=True).select(GENE, "highly_variable")


NORM = "x AS (SELECT cell_integer_id, gene_integer_id, value / sum(value) OVER (PARTITION BY cell_integer_id) * 10000.0 AS v FROM e)"


@query(f", {NORM} SELECT cell_integer_id, gene_integer_id, round(v, 6) AS value FROM x")
@on
def normalize_total(ds):
    return rnd(ds.X.normalize_total().df(), VALUE)


@query("SELECT cell_integer_id, gene_integer_id, round(ln(1 + value), 6) AS value FROM e")
@on
def log1p(ds):
    return rnd(ds.X.log1p().df(), VALUE)


@query(f", {NORM} SELECT cell_integer_id, gene_integer_id, round(ln(1 + v), 6) AS value FROM x WHERE cell_integer_id BETWEEN 100 AND 299 AND gene_integer_id < 500")
@on
def normalize_log1p_slice(ds):
    return rnd(ds.X.normalize_total().log1p()[100:300, :500].df(), VALUE)


@query(f", {NORM} SELECT gene_integer_id, round(coalesce(s, 0) / nc, 6) AS mean FROM g LEFT JOIN (SELECT gene_integer_id, sum(ln(1 + v)) s FROM x GROUP BY 1) USING (gene_integer_id), n")
@on
def norm_log1p_mean_axis0(ds):
    return rnd(ds.X.normalize_total().log1p().reduce("mean", axis=0), "mean")


@query(f", {NORM} SELECT cell_integer_id, round(greatest(coalesce(q, 0) / ng - power(coalesce(s, 0) / ng, 2), 0), 6) AS var FROM c LEFT JOIN (SELECT cell_integer_id, sum(ln(1 + v)) s, sum(power(ln(1 + v), 2)) q FROM x GROUP BY 1) USING (cell_integer_id), n")
@on
def norm_log1p_var_axis1(ds):
    return rnd(ds.X.normalize_total().log1p().reduce("var", axis=1), "var")


@query("SELECT count(*) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM e")
@on
def expression_stats(ds):
    return rnd(rnd(layout.expression_stats(ds.expression), "min", "max", "mean", "std"), "sum", n=4)


@query("SELECT nc AS n_cells, CAST(ng AS BIGINT) AS n_genes, (SELECT count(*) FROM e) AS n_entries, round((SELECT count(*) FROM e) / (nc * ng), 9) AS density, round(1 - (SELECT count(*) FROM e) / (nc * ng), 9) AS sparsity FROM n")
@on
def dataset_info(ds):
    return rnd(ds.info(), "density", "sparsity", n=9)


# windows, lists, tokens

ITEMS = "string_agg(CAST(gene_integer_id AS VARCHAR), ',' ORDER BY gene_integer_id) AS gene_sequence"
VALUES = "string_agg(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), ',' ORDER BY gene_integer_id) AS expr_sequence"
RANKED = "r AS (SELECT *, dense_rank() OVER (PARTITION BY cell_integer_id ORDER BY value DESC) d FROM e)"


def floors(df: DataFrame) -> DataFrame:
    return joined(df.withColumn("expr_sequence", F.transform("expr_sequence", lambda x: F.floor(x))), "gene_sequence", "expr_sequence")


@query(f", {RANKED} SELECT cell_integer_id, {ITEMS}, {VALUES} FROM r WHERE d <= 5 GROUP BY 1")
@on
def window_generic_topk(ds):
    return floors(windows.generic_window(ds.expression, 5))


@query(f", {RANKED} SELECT cell_integer_id, {ITEMS}, {VALUES} FROM r WHERE d <= 20 GROUP BY 1")
@on
def window_simple(ds):
    return floors(windows.simple_window(ds.expression, 20))


@query(f", {RANKED} SELECT cell_integer_id, {ITEMS} FROM r WHERE d <= 10 GROUP BY 1")
@on
def window_geneformer(ds):
    return joined(windows.item_window(ds.expression, 10), "gene_sequence")


@query(f", r AS (SELECT *, dense_rank() OVER (PARTITION BY cell_integer_id ORDER BY value DESC) d, dense_rank() OVER (PARTITION BY cell_integer_id ORDER BY value) a FROM e), m AS (SELECT *, max(a) OVER (PARTITION BY cell_integer_id) x FROM r) SELECT cell_integer_id, {ITEMS} FROM m WHERE d <= 10 AND a >= 0.6 * x GROUP BY 1")
@on
def window_geneformer_pct(ds):
    return joined(windows.item_window(ds.expression, 10, min_percentile=60), "gene_sequence")


BINS = "b AS (SELECT *, CAST(least(greatest(floor(round(ln(1 + value) * 10 / max(ln(1 + value)) OVER (PARTITION BY cell_integer_id), 9)), 0), 9) AS INT) AS bin, dense_rank() OVER (PARTITION BY cell_integer_id ORDER BY value DESC) d FROM e)"


@query(f", {BINS} SELECT cell_integer_id, {ITEMS}, string_agg(CAST(bin AS VARCHAR), ',' ORDER BY gene_integer_id) AS expr_sequence FROM b WHERE d <= 8 GROUP BY 1")
@on
def window_scgpt_binned(ds):
    return joined(windows.binned_window(ds.expression, 8), "gene_sequence", "expr_sequence")


@query(f", {RANKED} SELECT cell_integer_id, {ITEMS}, {VALUES} FROM r WHERE d <= 8 GROUP BY 1")
@on
def window_scgpt_raw(ds):
    return floors(windows.binned_window(ds.expression, 8, use_bins=False))


@query(f"SELECT cell_integer_id, {ITEMS}, {VALUES} FROM e GROUP BY 1")
@on
def group_lists(ds):
    return floors(windows.group_lists(ds.expression))


@query("SELECT cell_integer_id, gene_integer_id, CASE WHEN value > 0 THEN CAST(least(floor(value / 100 * 10.0), 9) + 50000 AS BIGINT) ELSE 0 END AS token FROM e")
@on
def expr_bins(ds):
    return ds.expression.select(CELL, GENE, tk.bin_token(F.col(VALUE) / 100, 10, 50_000).alias("token"))


# every cell's top 2,048 genes, at the full vocabulary and length; padding is left out of the text, its place is in "length"
TOKENS = f", {RANKED}, l AS (SELECT cell_integer_id, list_resize(list_prepend(1, list_append(list(CAST(gene_integer_id + 4 AS BIGINT) ORDER BY gene_integer_id), 2)), 2048, 0) AS ids FROM r WHERE d <= 2048 GROUP BY 1)"


def trimmed(df: DataFrame, *more: str) -> DataFrame:
    """``input_ids`` as comma-joined text without its padding, and the columns ``more`` as far as the tokens before [SEP]."""
    n = tk.token_count(F.col("input_ids"))
    cut = df.withColumns({"input_ids": F.slice("input_ids", 1, n), **{c: F.slice(c, 1, n - 1) for c in more}})
    return joined(cut, "input_ids", *more)


@query(TOKENS + " SELECT cell_integer_id, array_to_string(list_filter(ids, lambda x: x <> 0), ',') AS input_ids, CAST(len(list_filter(ids, lambda x: x <> 0)) AS BIGINT) AS n_tokens, CAST(len(ids) AS BIGINT) AS length FROM l")
@on
def tokens_geneformer(ds):
    t = windows.tokenizer("geneformer")(ds.expression)
    n = tk.token_count(F.col("input_ids")).cast("bigint")
    return trimmed(t.select(CELL, "input_ids", n.alias("n_tokens"), F.size("input_ids").cast("bigint").alias("length")))


@query(f", {BINS}, k AS (SELECT *, row_number() OVER (PARTITION BY cell_integer_id ORDER BY gene_integer_id) i FROM b WHERE d <= 1024), l AS (SELECT cell_integer_id, list(CAST(gene_integer_id + 4 AS BIGINT) ORDER BY gene_integer_id) a, list(CAST(bin + 50000 AS BIGINT) ORDER BY gene_integer_id) v FROM k WHERE i <= 1024 GROUP BY 1) SELECT cell_integer_id, array_to_string(list_prepend(1, list_append(a, 2)), ',') AS input_ids, array_to_string(list_prepend(0, v), ',') AS values, CAST(1026 AS BIGINT) AS length FROM l")
@on
def tokens_scgpt(ds):
    t = windows.tokenizer("scgpt", max_items=1024)(ds.expression)
    return trimmed(t.select(CELL, "input_ids", "values", F.size("input_ids").cast("bigint").alias("length")), "values")


@query(TOKENS + ", t AS (SELECT cell_integer_id, unnest(ids) AS token, CAST(generate_subscripts(ids, 1) - 1 AS INT) AS pos FROM l) SELECT cell_integer_id, pos, token, gene_id, CASE token WHEN 1 THEN 'CLS' WHEN 2 THEN 'SEP' WHEN 3 THEN 'MASK' END AS special FROM t LEFT JOIN g ON gene_integer_id + 4 = token WHERE token <> 0")
@on
def decode_tokens(ds):
    t = windows.tokenizer("geneformer")(ds.expression).select(CELL, F.col("input_ids").alias("ids"))
    return tk.decode(t, "ids", tk.vocabulary(ds.genes), [CELL])


@query("SELECT CAST(gene_integer_id + 4 AS BIGINT) AS token, gene_integer_id, gene_id FROM g")
@on
def vocab(ds):
    return tk.vocabulary(ds.genes)


@query(f", {RANKED}, l AS (SELECT cell_integer_id, list_resize(list_prepend(1, list_append(list(CAST(gene_integer_id + 4 AS BIGINT) ORDER BY value DESC, gene_integer_id), 2)), 2048, 0) AS ids FROM r WHERE d <= 2048 GROUP BY 1) SELECT cell_integer_id, array_to_string(list_filter(ids, lambda x: x <> 0), ',') AS input_ids FROM l")
@on
def pipeline_geneformer(ds):
    return trimmed(batches.batched(ds.expression, batches.BatchPlan()).select(CELL, "input_ids"))


# layers, vectors, pairs, metadata


@query(", u AS (SELECT cell_integer_id, gene_integer_id FROM e UNION SELECT cell_integer_id, gene_integer_id FROM layers WHERE spliced IS NOT NULL UNION SELECT cell_integer_id, gene_integer_id FROM layers WHERE unspliced IS NOT NULL) SELECT u.*, spliced, unspliced FROM u LEFT JOIN layers USING (cell_integer_id, gene_integer_id)")
@on
def layers_wide(ds):
    return ingest.layers_wide(ds.expression, {n: ds.matrix(n).df() for n in ("spliced", "unspliced")})


@query("SELECT coalesce(l.cell_integer_id, e.cell_integer_id) AS cell_integer_id, coalesce(l.gene_integer_id, e.gene_integer_id) AS gene_integer_id, spliced, unspliced, value AS counts FROM layers l FULL JOIN e ON l.cell_integer_id = e.cell_integer_id AND l.gene_integer_id = e.gene_integer_id")
@on
def layers_add(ds):
    return ingest.add_layer(ds.tables["layers"], "counts", ds.expression)


VEC = "v AS (SELECT cell_integer_id, key FROM (SELECT cell_integer_id, key, row_number() OVER (PARTITION BY cell_integer_id ORDER BY loaded_at DESC NULLS LAST) k FROM cells) WHERE k = 1 AND key IS NOT NULL)"


def with_vectors(spark, d) -> Dataset:
    ds = dataset(spark, d)
    keys = table(spark, d, "cells").groupBy(CELL).agg(F.max_by("key", F.coalesce(F.col("loaded_at"), F.lit("1900-01-01").cast("timestamp_ntz"))).alias("key"))
    ds.add_obs("key", keys)
    return ds


@query(f", {VEC} SELECT cell_integer_id, batch, CAST(len(key) AS BIGINT) AS dims FROM c LEFT JOIN v USING (cell_integer_id)")
def obsm_join(spark, d):
    return with_vectors(spark, d).cells.select(CELL, "batch", F.when(F.col("key").isNotNull(), F.size("key")).cast("bigint").alias("dims"))


@query(f", {VEC} SELECT cell_integer_id, CAST(unnest(key) AS DOUBLE) AS x, CAST(generate_subscripts(key, 1) - 1 AS BIGINT) AS i FROM v WHERE cell_integer_id < 100")
def obsm_slice(spark, d):
    v = with_vectors(spark, d).vectors("key", key=slice(0, 100))
    return v.select(CELL, F.posexplode("key").alias("i", "x")).select(CELL, F.col("x").cast("double").alias("x"), F.col("i").cast("bigint").alias("i"))


@query("SELECT coalesce(a.id_i, b.id_j) AS id_i, coalesce(a.id_j, b.id_i) AS id_j, coalesce(CAST(a.connectivities AS DOUBLE), 0) AS connectivities, coalesce(CAST(b.distances AS DOUBLE), 0) AS reverse FROM cellsxcells a FULL JOIN cellsxcells b ON a.id_i = b.id_j AND a.id_j = b.id_i", pre=False)
@on
def obsp_full_merge(ds):
    """Connectivities beside the distances of the opposite direction."""
    p = ds.tables["cellsxcells"]
    return ingest.merge_pairs(p.select("id_i", "id_j", "connectivities"), p.select(F.col("id_j").alias("id_i"), F.col("id_i").alias("id_j"), F.col("distances").alias("reverse")))


@query("SELECT id_i, id_j, CAST(connectivities AS DOUBLE) AS value FROM cellsxcells WHERE id_i BETWEEN 100 AND 899 AND id_j BETWEEN 100 AND 899 AND connectivities IS NOT NULL AND connectivities <> 0", pre=False)
@on
def obsp_slice(ds):
    return ds.pairs("connectivities", key=slice(100, 900))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1", pre=False)
def uns_json(spark, d):
    k = ingest.json_field("props", "k", "bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("SELECT c.cell_integer_id, cell_id, k AS n_stored FROM c LEFT JOIN (SELECT cell_integer_id, count(*) k FROM e GROUP BY 1) USING (cell_integer_id)")
@on
def obs_add_column(ds):
    ds.add_obs("n_stored", ds.expression.groupBy(CELL).agg(F.count(F.lit(1)).alias("n_stored")))
    return ds.cells.select(CELL, "cell_id", "n_stored")


@query("SELECT vec_id AS cell_integer_id, i AS gene_integer_id, x AS value FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i FROM embeddings) WHERE x <> 0", pre=False)
def wide_to_coo(spark, d):
    return ingest.wide_to_coo(table(spark, d, "embeddings"), "vec_id", "embedding")


# several inputs, streams of groups


def halves(ds: Dataset) -> list[dict[str, DataFrame]]:
    """The dataset as two inputs: even and odd cells, each numbered from 0."""
    out = []
    for k in (0, 1):
        own = (F.col(CELL) / 2).cast("bigint")
        cut = lambda t: t.filter(F.col(CELL) % 2 == k).withColumn(CELL, own)  # noqa: E731, B023
        out.append({"cells": cut(ds.cells.select(CELL, "cell_id", "batch")), "genes": ds.genes, "expression": cut(ds.expression)})
    return out


EVEN = "(SELECT count(*) FROM c WHERE cell_integer_id % 2 = 0)"


@query(f"SELECT CASE WHEN cell_integer_id % 2 = 0 THEN cell_integer_id // 2 ELSE cell_integer_id // 2 + {EVEN} END AS cell_integer_id, gene_integer_id, value FROM e")
@on
def multi_file_union(ds):
    return ingest.union_inputs(halves(ds), ["even", "odd"])["expression"]


@query(f"SELECT CASE WHEN cell_integer_id % 2 = 0 THEN cell_integer_id // 2 ELSE cell_integer_id // 2 + {EVEN} END AS cell_integer_id, cell_id, CASE WHEN cell_integer_id % 2 = 0 THEN 'original_data' ELSE 'odd' END AS source_file FROM c")
@on
def append_union(ds):
    """Two inputs, the second appended to the stored first."""
    old, new = halves(ds)
    folder = scratch_path(ds.spark, "appended")
    ingest.write_dataset(old, folder, gene_copy=False, values="double")
    ingest.append_tables(ds.spark, new, "odd", folder)
    return Dataset.open(ds.spark, folder).cells.select(CELL, "cell_id", "source_file")


@query(f"SELECT CASE WHEN cell_integer_id % 2 = 0 THEN cell_integer_id // 2 ELSE cell_integer_id // 2 + {EVEN} END AS cell_integer_id, gene_integer_id, value FROM e")
@on
def compacted_append(ds):
    """The matrix after an append and a compaction of the parts."""
    old, new = halves(ds)
    folder = scratch_path(ds.spark, "compacted")
    ingest.write_dataset(old, folder, values="double")
    ingest.append_tables(ds.spark, new, "odd", folder)
    ingest.compact(ds.spark, folder)
    return Dataset.open(ds.spark, folder).expression


@query("SELECT * FROM e")
@on
def source_parts(ds):
    """The stored matrix row group by row group through the partitioned source."""
    return partitioned.read_parts(ds.spark, ds.expression)


@query("SELECT cell_integer_id // 1000 AS chunk, count(*) AS n, round(sum(value), 6) AS total FROM e WHERE gene_integer_id IN (0, 5, 6, 100) GROUP BY 1")
@on
def gene_chunks(ds):
    """Counts and totals of some genes, chunk of cells by chunk."""
    return rnd(ds.gene_chunk_rows([0, 5, 6, 100], 1000).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(VALUE).alias("total")), "total")


@query("SELECT count(DISTINCT cell_integer_id) AS n_cells, CAST(ceil(count(DISTINCT cell_integer_id) / 64.0) AS BIGINT) AS n_batches, CAST(count(*) + 2 * count(DISTINCT cell_integer_id) AS BIGINT) AS n_tokens FROM e")
@on
def loader_totals(ds):
    """Cells, batches and tokens that the training loader delivers in one epoch."""
    loader = batches.BatchLoader(ds.expression, batches.BatchPlan(batch_size=64))
    n = sum(1 for _ in loader)
    return ds.spark.createDataFrame([(loader.metrics["rows"], n, loader.metrics["tokens"])], "n_cells bigint, n_batches bigint, n_tokens bigint")


@query("SELECT gene_id, 'left' AS side FROM g WHERE gene_integer_id >= 950 UNION ALL SELECT gene_id, 'right' FROM g WHERE gene_integer_id < 20")
@on
def gene_set_diff(ds):
    return ingest.gene_set_difference(ds.genes.filter(F.col(GENE) >= 20), ds.genes.filter(F.col(GENE) < 950))


@query("SELECT DISTINCT cell_integer_id, gene_integer_id FROM expression", pre=False)
def distinct_pairs(spark, d):
    return windows.distinct_pairs(table(spark, d, "expression"))


@query("SELECT user_id, count(DISTINCT event_id // 500) AS n_parts FROM events GROUP BY 1 HAVING count(DISTINCT event_id // 500) > 1", pre=False)
def boundary_cells(spark, d):
    """Groups whose rows lie in more than one fragment of 500 events."""
    e = table(spark, d, "events").withColumn("part", F.floor(F.col("event_id") / 500))
    return windows.split_groups(e, "user_id", "part")


@query("SELECT c.cell_integer_id, n_genes_by_counts AS expected, coalesce(k, 0) AS observed, coalesce(k, 0) >= n_genes_by_counts AS complete FROM c LEFT JOIN (SELECT cell_integer_id, count(*) k FROM e GROUP BY 1) USING (cell_integer_id)")
@on
def group_completeness(ds):
    return windows.completeness(ds.expression, ds.cells.select(CELL, F.col("n_genes_by_counts").alias("expected")), CELL)


@query("SELECT row_number() OVER (ORDER BY turn, event_type) - 1 AS place, event_type, turn FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS turn FROM events)", pre=False)
def stratified_interleave(spark, d):
    """Place, stratum and turn of the seeded stratified order; which row of a stratum comes when is the seed's affair."""
    r = shuffle.stratified_order(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", seed=7)
    return r.select("place", "event_type", "turn")


@query("SELECT cell_integer_id // 32 AS batch, avg(x) AS mean_distance, count(*) AS n FROM (SELECT cell_integer_id, abs(cell_integer_id - lag(cell_integer_id) OVER (PARTITION BY cell_integer_id // 32 ORDER BY cell_integer_id)) AS x FROM c) GROUP BY 1")
@on
def batch_l1(ds):
    """Distance of neighbours in batches of 32 read in sequence."""
    placed = global_rank(ds.cells.select(CELL), [F.col(CELL)], "place").withColumn("batch", F.floor(F.col("place") / 32).cast("bigint"))
    return shuffle.neighbour_distance(placed, CELL)


@query("SELECT gene_integer_id, starts_with(gene_symbol, 'TO') AS flagged FROM g")
@on
def prefix_flag(ds):
    return ds.genes.select(GENE, preprocess.prefix_flag("gene_symbol", "TO").alias("flagged"))


@query("SELECT cell_id, batch FROM c ORDER BY cell_integer_id LIMIT 25")
@on
def cli_limit(ds):
    return limited(ds, "SELECT cell_id, batch FROM cells ORDER BY cell_integer_id", 25)


# plain SQL over the dataset's tables


def _sql(name: str, text: str, oracle: str | None = None):
    def run(spark, d):
        return dataset(spark, d).sql(nudged(text))

    run.__name__ = name
    body = oracle or text
    for long, short in (("expression", "e"), ("cells", "c"), ("genes", "g")):
        body = body.replace(f"FROM {long}", f"FROM {short}").replace(f"JOIN {long}", f"JOIN {short}").replace(f", {long} ", f", {short} ")
    query(body if not body.startswith("WITH ") else ", " + body[5:])(run)


_sql("sql_counts", "SELECT count(*) AS n_cells, count(DISTINCT batch) AS n_batches, count(CASE WHEN high_mito THEN 1 END) AS n_mito FROM cells")
_sql("sql_expr_stats", "SELECT min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, count(*) AS n FROM expression")
_sql("sql_star_join", "SELECT x.batch, y.gene_type, count(*) AS n, round(sum(value), 4) AS total FROM expression f JOIN cells x ON f.cell_integer_id = x.cell_integer_id JOIN genes y ON f.gene_integer_id = y.gene_integer_id GROUP BY x.batch, y.gene_type")
_sql("sql_left_join_agg", "SELECT x.cell_id, count(f.gene_integer_id) AS n, round(coalesce(sum(f.value), 0), 6) AS total FROM cells x LEFT JOIN expression f ON x.cell_integer_id = f.cell_integer_id GROUP BY x.cell_id")
_sql("sql_in_subquery", "SELECT cell_integer_id, gene_integer_id, value FROM expression WHERE cell_integer_id IN (SELECT cell_integer_id FROM cells WHERE batch = 'batch_3')")
_sql("sql_layers_join", "SELECT f.cell_integer_id, f.gene_integer_id, f.value, l.spliced FROM expression f JOIN layers l ON f.cell_integer_id = l.cell_integer_id AND f.gene_integer_id = l.gene_integer_id WHERE l.spliced > 1")
_sql("sql_comma_join", "SELECT y.gene_id, count(*) AS n FROM expression f, genes y WHERE f.gene_integer_id = y.gene_integer_id AND y.highly_variable = true GROUP BY y.gene_id")
_sql("sql_cte", "WITH s AS (SELECT cell_integer_id, avg(value) AS m FROM expression GROUP BY cell_integer_id) SELECT f.cell_integer_id, count(*) AS n FROM expression f JOIN s ON f.cell_integer_id = s.cell_integer_id AND f.value > s.m GROUP BY f.cell_integer_id")
_sql("sql_group_having", "SELECT batch, count(*) AS n_cells, count(DISTINCT donor) AS n_donors FROM cells WHERE batch IS NOT NULL GROUP BY batch HAVING n_cells > 20")
_sql("sql_stddev", "SELECT gene_integer_id, round(stddev(value), 6) AS sd, round(variance(value), 6) AS v FROM expression GROUP BY gene_integer_id")
_sql("sql_rank", "SELECT cell_integer_id, gene_integer_id, CAST(r AS BIGINT) AS r FROM (SELECT cell_integer_id, gene_integer_id, rank() OVER (PARTITION BY cell_integer_id ORDER BY value DESC) AS r FROM expression) t WHERE r <= 3")
_sql("sql_row_number", "SELECT cell_integer_id, gene_integer_id, CAST(r AS BIGINT) AS r FROM (SELECT cell_integer_id, gene_integer_id, row_number() OVER (PARTITION BY cell_integer_id ORDER BY value DESC, gene_integer_id) AS r FROM expression) t WHERE r <= 3")
_sql("sql_topk", "SELECT cell_integer_id, round(sum(value), 6) AS total FROM expression GROUP BY cell_integer_id ORDER BY sum(value) DESC, cell_integer_id LIMIT 20")
_sql("sql_distinct", "SELECT DISTINCT batch, high_mito FROM cells")
_sql("sql_intersect", "SELECT cell_integer_id FROM cells WHERE high_mito = true INTERSECT SELECT cell_integer_id FROM expression WHERE gene_integer_id < 100")
_sql("sql_except", "SELECT cell_integer_id FROM cells EXCEPT SELECT cell_integer_id FROM expression")


# streams


def _events(spark, d):
    return streams.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


@query("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1", pre=False)
def stream_batches(spark, d):
    """Counts per group over a file stream."""
    s = _events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    return streams.run_to_table(s, "complete")


@query("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1", pre=False)
def stream_groups(spark, d):
    """Complete groups out of a stream, each emitted once."""
    expected = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = streams.run_to_table(streams.complete_groups(_events(spark, d), expected, "user_id", "event_id", "value"))
    return out.select("user_id", F.size("items").cast("bigint").alias("n"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"))


@query("SELECT cell_integer_id, count(*) AS n, CAST(sum(gene_integer_id) AS BIGINT) AS genes FROM e GROUP BY 1")
def stream_positions(spark, d):
    """Whole groups out of a stream in group order, without knowing their sizes; files end inside groups."""
    rows, path = dataset(spark, d).expression, scratch_path(spark, "ordered")
    placed = global_rank(rows, [F.col(CELL), F.col(GENE)], "place")
    quarter = rows.count() // 4 + 1
    for k in range(4):  # one file after another, as a feed would deliver them
        placed.filter(F.floor(F.col("place") / quarter) == k).select(CELL, GENE, VALUE).coalesce(1).write.mode("append").parquet(path)
    s = streams.file_stream(spark, path, spark.read.parquet(path).schema)
    out = streams.groups_by_position(s, CELL, GENE, VALUE, scratch_path(spark, "groups"), scratch_path(spark, "mark"))
    return out.select(CELL, F.size("items").cast("bigint").alias("n"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("genes"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1", pre=False)
def stream_foreach(spark, d):
    """Micro-batches handed to a sink that appends them to a table."""
    path = scratch_path(spark, "sink")
    streams.run_foreach(_events(spark, d), lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}"))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
