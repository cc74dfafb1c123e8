"""An open dataset: SQL, filters, point access, matrix views, metadata, vectors, pairwise tables, mutations."""

from __future__ import annotations

import json
import threading
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import preprocess
from .operators.matrix import CELL, GENE, VALUE, LazyMatrix
from .plans.filters import where
from .plans.selectors import Selector, TableSelector, compose, normalize, parse_key
from .sources import ingest, layout

_NAMES = threading.RLock()
MAX_DENSE = 1 << 28  # numbers of an array on the driver
BROADCAST_ROWS = 200_000  # dimension tables up to this many rows are broadcast, others join by shuffle


class Dataset:
    """Tables of one dataset and lazy views on them. Nothing runs until a result is asked for."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], shape: tuple[int, int] | Callable[[], tuple[int, int]] | None = None, folder: str | None = None, config: layout.Config | None = None):
        for n in ("cells", "genes", "expression"):
            if n not in tables:
                raise FileNotFoundError(f"the dataset has no table {n}")
        self.spark, self.tables, self.folder, self.config = spark, tables, folder, config
        self._shape = shape
        self._uns = dict(config.uns) if config else {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Dataset:
        """Open a dataset folder; FileNotFoundError if it has no config.json."""
        c = layout.load_config(spark, folder)
        return cls(spark, {n: layout.read_table(spark, folder, c, n) for n in c.tables}, tuple(c.shape), folder, c)

    @property
    def shape(self) -> tuple[int, int]:
        if callable(self._shape):
            self._shape = self._shape()
        if self._shape is None:
            a = self.cells.agg(F.max(CELL)).first()[0]
            b = self.genes.agg(F.max(GENE)).first()[0]
            self._shape = (0 if a is None else a + 1, 0 if b is None else b + 1)
        return self._shape

    @property
    def cells(self) -> DataFrame:
        return self.tables["cells"]

    @property
    def genes(self) -> DataFrame:
        return self.tables["genes"]

    @property
    def expression(self) -> DataFrame:
        return self.tables["expression"]

    def sql(self, text: str) -> DataFrame:
        """Any SQL over the dataset's tables by their names.

        A query is bound to its tables when it is analysed, at once; the names are views only for that moment, so
        datasets don't see one another's tables, and views of the same name that were there before come back.
        """
        with _NAMES:
            before = {n: self.spark.table(n) for n in self.tables if self.spark.catalog.tableExists(n)}
            try:
                for n, d in self.tables.items():
                    d.createOrReplaceTempView(n)
                return self.spark.sql(text)
            finally:
                for n in self.tables:
                    self.spark.catalog.dropTempView(n)
                for n, d in before.items():
                    d.createOrReplaceTempView(n)

    def filter_cells(self, **conditions) -> DataFrame:
        return where(self.cells, **conditions)

    def filter_genes(self, **conditions) -> DataFrame:
        return where(self.genes, **conditions)

    # point and range access

    def _ids(self, table: DataFrame, key: str, name: str, wanted: list) -> list[int]:
        wanted = [wanted] if isinstance(wanted, (str, int, np.integer)) else list(wanted)
        text = [w for w in wanted if isinstance(w, str)]
        if not text:
            return [int(w) for w in wanted]
        got = {r[name]: r[key] for r in table.filter(F.col(name).isin(text)).select(name, key).collect()}  # as many as asked for
        if missing := [w for w in text if w not in got]:
            raise ValueError(f"unknown {name}: {', '.join(missing[:5])}")
        return [got[w] if isinstance(w, str) else int(w) for w in wanted]

    def _named(self, d: DataFrame, *keep: str) -> DataFrame:
        c, g = self.cells.select(F.col(CELL).alias("__c"), "cell_id"), self.genes.select(F.col(GENE).alias("__g"), "gene_id")
        small = lambda x, n: F.broadcast(x) if n <= BROADCAST_ROWS else x
        d = d.join(small(c, self.shape[0]), d[CELL] == F.col("__c"), "left").join(small(g, self.shape[1]), d[GENE] == F.col("__g"), "left")
        return d.select(*keep, F.coalesce("cell_id", F.concat(F.lit("cell_"), d[CELL].cast("string"))).alias("cell_id"), F.coalesce("gene_id", F.concat(F.lit("gene_"), d[GENE].cast("string"))).alias("gene_id"), VALUE)

    def cell_expression(self, cells) -> DataFrame:
        """(cell_id, gene_id, value) of some cells, by name or number."""
        s = normalize(self._ids(self.cells, CELL, "cell_id", cells), self.shape[0])
        return self._named(s.apply(self.expression, CELL))

    def gene_expression(self, genes) -> DataFrame:
        """(cell_id, gene_id, value) of some genes; reads the copy clustered by gene if there is one."""
        s = normalize(self._ids(self.genes, GENE, "gene_id", genes), self.shape[1])
        return self._named(s.apply(self.tables.get("expression_by_gene", self.expression), GENE))

    def _known_genes(self, genes):
        """The selector of some genes; unknown names are warned of and left out."""
        genes = [genes] if isinstance(genes, (str, int)) else list(genes)
        text = [g for g in genes if isinstance(g, str)]
        known = {r["gene_id"] for r in self.genes.filter(F.col("gene_id").isin(text)).select("gene_id").collect()} if text else set()
        if missing := [g for g in text if g not in known]:
            warnings.warn(f"unknown genes: {', '.join(missing[:10])}", stacklevel=3)
        return normalize(self._ids(self.genes, GENE, "gene_id", [g for g in genes if not isinstance(g, str) or g in known]), self.shape[1])

    def gene_chunks(self, genes, chunk: int = 25_000) -> Iterator[tuple[range, DataFrame]]:
        """(range of cell ids, their (cell_id, gene_id, value) of some genes), chunk by chunk; unknown gene names are warned of and left out.

        Every chunk is a query of its own; :meth:`gene_chunk_rows` has all of them in one.
        """
        s = self._known_genes(genes)
        for start in range(0, self.shape[0], chunk):
            own = range(start, min(start + chunk, self.shape[0]))
            rows = normalize(slice(own.start, own.stop), self.shape[0]).apply(self.expression, CELL)
            yield own, self._named(s.apply(rows, GENE))

    def gene_chunk_rows(self, genes, chunk: int = 25_000) -> DataFrame:
        """(chunk, cell_id, gene_id, value): the rows of all of :meth:`gene_chunks` with the number of their chunk, in one scan.

        Reads the copy clustered by gene if there is one. Cells that the cell table lacks have rows too.
        """
        rows = self._known_genes(genes).apply(self.tables.get("expression_by_gene", self.expression), GENE)
        return self._named(rows.withColumn("chunk", F.floor(F.col(CELL) / chunk).cast("bigint")), "chunk")

    def submatrix(self, cells: Any = None, genes: Any = None, layer: str | None = None) -> DataFrame:
        """(cell_id, gene_id, value) of a rectangle given by selectors."""
        return self._named(self.matrix(layer)[cells, genes].df())

    def row_ranges(self, cells: Any = None) -> DataFrame:
        """(cell_integer_id, start, stop) of the rows of selected cells in the cell-clustered table."""
        s = normalize(cells, self.shape[0])
        index = layout.start_index(self.expression, self.cells)
        return s.apply(index, CELL).select(CELL, F.col("cell_start_index").alias("start"), (F.col("cell_start_index") + F.col("n_rows")).alias("stop"))

    # matrix views

    def matrix(self, layer: str | None = None) -> LazyMatrix:
        if layer is None:
            return LazyMatrix(self.expression, self.shape)
        if "layers" not in self.tables or layer not in self.layer_names:
            raise KeyError(layer)
        return LazyMatrix(self.tables["layers"], self.shape, layer)

    @property
    def X(self) -> LazyMatrix:
        return self.matrix()

    @property
    def layer_names(self) -> list[str]:
        return [c for c in self.tables["layers"].columns if c not in (CELL, GENE)] if "layers" in self.tables else []

    def view(self) -> View:
        return View(self, normalize(None, self.shape[0]), normalize(None, self.shape[1]))

    def __getitem__(self, key) -> View:
        return self.view()[key]

    # metadata, vectors, pairs

    def _meta(self, table: DataFrame, key: str) -> DataFrame:
        hide = {key} | {f.name for f in table.schema.fields if isinstance(f.dataType, T.ArrayType)}
        return table.orderBy(key).select(*(c for c in table.columns if c not in hide))

    @property
    def obs(self) -> DataFrame:
        """Cell metadata in id order, without the id and vector columns."""
        return self._meta(self.cells, CELL)

    @property
    def var(self) -> DataFrame:
        return self._meta(self.genes, GENE)

    def vectors(self, name: str, axis: int = 0, key: Any = None) -> DataFrame:
        """(id, vector) of selected ids that have one."""
        table, k, n = (self.cells, CELL, self.shape[0]) if axis == 0 else (self.genes, GENE, self.shape[1])
        return normalize(key, n).apply(table, k).filter(F.col(name).isNotNull()).select(k, name)

    def pairs(self, name: str, axis: int = 0, key: Any = None) -> DataFrame:
        """(id_i, id_j, value) of one pairwise key among the selected ids; null is 0 and left out."""
        table = self.tables["cellsxcells" if axis == 0 else "genesxgenes"]
        s = normalize(key, self.shape[axis])
        return s.apply(s.apply(table, "id_i"), "id_j").select("id_i", "id_j", F.col(name).cast("double").alias(VALUE)).filter(F.col(VALUE).isNotNull() & (F.col(VALUE) != 0))

    def pairs_dense(self, name: str, axis: int = 0, key: Any = None) -> np.ndarray:
        s = normalize(key, self.shape[axis])
        if len(s) ** 2 > MAX_DENSE:
            raise ValueError(f"{len(s)} x {len(s)} numbers are too many for the driver")
        ids = s.positions()
        order = np.argsort(ids, kind="stable")
        p = self.pairs(name, axis, key).toPandas()
        i, j = (order[np.searchsorted(ids, p[c].to_numpy(), sorter=order)] for c in ("id_i", "id_j"))
        out = np.zeros((len(s), len(s)))
        out[i, j] = p[VALUE].to_numpy(float)
        return out

    def vector_array(self, name: str, axis: int = 0, key: Any = None) -> np.ndarray:
        """One row per selected id in order (repeats too); NaN where an id has no vector. Lengths must agree."""
        table, k, n = (self.cells, CELL, self.shape[0]) if axis == 0 else (self.genes, GENE, self.shape[1])
        s = normalize(key, n)
        v = self.vectors(name, axis, s)
        dims = [r[0] for r in v.select(F.size(name)).distinct().limit(2).collect()]
        if len(dims) > 1:
            raise ValueError(f"vectors of {name!r} differ in length")
        if len(s) * max([*dims, 1]) > MAX_DENSE:
            raise ValueError(f"{len(s)} vectors are too many for the driver")
        t = v.select(F.col(k).cast("bigint").alias("id"), F.col(name).cast("array<double>").alias("v")).toArrow()
        ids = t.column("id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims[0] if dims else 0)
        out, order = np.full((len(s), x.shape[1]), np.nan), np.argsort(ids)
        at = np.searchsorted(ids, s.positions(), sorter=order)
        hit = at < len(ids)
        hit[hit] = ids[order[at[hit]]] == s.positions()[hit]
        out[hit] = x[order[at[hit]]]
        return out

    @property
    def uns(self) -> dict:
        """Unstructured values; assign with :meth:`set_uns`."""
        return dict(self._uns)

    def set_uns(self, key: str, value: Any) -> None:
        self._uns[key] = json.loads(json.dumps(value, default=lambda x: x.tolist()))
        self._save_uns()

    def del_uns(self, key: str) -> None:
        del self._uns[key]
        self._save_uns()

    def _save_uns(self) -> None:
        if self.folder:
            self.config.uns = self._uns
            layout.save_config(self.spark, self.folder, self.config)

    # mutations: a new version of one table, made current by replacing config.json

    def _replace(self, name: str, df: DataFrame, by: list[str]) -> None:
        if self.folder:
            v = layout.next_version(name, self.config.tables.get(name))
            layout.write_clustered(df, f"{self.folder}/{v}", by)
            self.config.tables[name] = [v]
            self.config.fill.pop(name, None)
            layout.save_config(self.spark, self.folder, self.config)
            df = self.spark.read.parquet(f"{self.folder}/{v}")
        self.tables[name] = df

    def _fixed(self, family: str) -> tuple[str, ...]:
        return tuple(self.config.columns.get(family, {}).get("immutable", ())) if self.config else ()

    def add_obs(self, name: str, values: DataFrame) -> None:
        """Add or replace a cell column, scalar or vector, from (cell_integer_id, name)."""
        self._replace("cells", ingest.add_column(self.cells, CELL, name, values, self._fixed("obs")), [CELL])

    def add_var(self, name: str, values: DataFrame) -> None:
        self._replace("genes", ingest.add_column(self.genes, GENE, name, values, self._fixed("var")), [GENE])

    def drop_obs(self, name: str) -> None:
        self._drop("cells", "obs", name, [CELL])

    def drop_var(self, name: str) -> None:
        self._drop("genes", "var", name, [GENE])

    def _drop(self, table: str, family: str, name: str, by: list[str]) -> None:
        if name not in self.tables[table].columns:
            raise KeyError(name)
        if name in self._fixed(family) or name in by:
            raise ValueError(f"{name!r} can't be changed")
        self._replace(table, self.tables[table].drop(name), by)

    def add_layer(self, name: str, values: DataFrame) -> None:
        base = self.tables["layers"] if "layers" in self.tables else self.expression.select(CELL, GENE)
        self._replace("layers", ingest.add_layer(base, name, values), [CELL, GENE])

    def drop_layer(self, name: str) -> None:
        self._drop("layers", "layers", name, [CELL, GENE])

    def add_pairs(self, name: str, values: DataFrame, axis: int = 0) -> None:
        """Add a pairwise key from (id_i, id_j, value)."""
        table, n = ("cellsxcells", self.shape[0]) if axis == 0 else ("genesxgenes", self.shape[1])
        v = values.select("id_i", "id_j", F.col(VALUE).alias(name))
        if not v.filter((F.col("id_i") >= n) | (F.col("id_j") >= n) | (F.col("id_i") < 0) | (F.col("id_j") < 0)).isEmpty():
            raise ValueError("a pair lies outside the axis")
        self._replace(table, ingest.merge_pairs(self.tables[table], v) if table in self.tables else v, ["id_i", "id_j"])

    def drop_pairs(self, name: str, axis: int = 0) -> None:
        table = "cellsxcells" if axis == 0 else "genesxgenes"
        self._drop(table, "pairs", name, ["id_i", "id_j"])

    # summaries

    def info(self) -> DataFrame:
        """One row: cells, genes, stored entries, density, sparsity."""
        n, m = self.shape
        return self.expression.agg(F.count(F.lit(1)).alias("n_entries")).select(F.lit(n).cast("bigint").alias("n_cells"), F.lit(m).cast("bigint").alias("n_genes"), "n_entries", (F.col("n_entries") / F.lit(float(n * m))).alias("density"), (1 - F.col("n_entries") / F.lit(float(n * m))).alias("sparsity"))

    def calculate_qc(self, inplace: bool = True) -> tuple[DataFrame, DataFrame]:
        """Cell and gene quality tables; with ``inplace`` their columns are added to the metadata."""
        c, g = preprocess.cell_qc(self.expression), preprocess.gene_qc(self.expression, self.genes)
        if inplace:
            for name in c.columns[1:]:
                self.add_obs(f"qc_{name}", c.select(CELL, F.col(name).alias(f"qc_{name}")))
            for name in g.columns[2:]:
                self.add_var(f"qc_{name}", g.select(GENE, F.col(name).alias(f"qc_{name}")))
        return c, g


class View:
    """Rows and columns of a dataset; slicing a view composes, whatever was selected before."""

    def __init__(self, data: Dataset, rows: Selector, cols: Selector, transforms: tuple = ()):
        self.data, self.rows, self.cols, self.transforms = data, rows, cols, transforms

    def __getitem__(self, key) -> View:
        a, b = parse_key(key)
        return View(self.data, compose(self.rows, a), compose(self.cols, b), self.transforms)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.cols)

    @property
    def X(self) -> LazyMatrix:
        m = self.data.matrix()
        return LazyMatrix(m.source, m.shape_all, m.value, self.rows, self.cols, self.transforms)

    def layer(self, name: str) -> LazyMatrix:
        m = self.data.matrix(name)
        return LazyMatrix(m.source, m.shape_all, m.value, self.rows, self.cols)

    @property
    def obs(self) -> DataFrame:
        return self.data._meta(self.rows.apply(self.data.cells, CELL), CELL)

    @property
    def var(self) -> DataFrame:
        return self.data._meta(self.cols.apply(self.data.genes, GENE), GENE)

    def with_transforms(self, *transforms: tuple) -> View:
        return View(self.data, self.rows, self.cols, (*self.transforms, *transforms))

    def filter_cells(self, **bounds) -> View:
        """Only the rows that pass :func:`preprocess.filter_cells`' bounds; none left raises ValueError."""
        ok = preprocess.passing(self.X.df(), CELL, bounds.get("min_counts"), bounds.get("max_counts"), bounds.get("min_genes"), bounds.get("max_genes"))
        return self._kept(ok, CELL, self.rows, 0)

    def filter_genes(self, **bounds) -> View:
        ok = preprocess.passing(self.X.df(), GENE, bounds.get("min_counts"), bounds.get("max_counts"), bounds.get("min_cells"), bounds.get("max_cells"))
        return self._kept(ok, GENE, self.cols, 1)

    def where_cells(self, **conditions) -> View:
        """Only the rows whose metadata meet the filter; the ids stay in a table."""
        return self._with(where(self.rows.apply(self.data.cells, CELL), **conditions).select(CELL), 0)

    def where_genes(self, **conditions) -> View:
        return self._with(where(self.cols.apply(self.data.genes, GENE), **conditions).select(GENE), 1)

    def _with(self, ids: DataFrame, axis: int) -> View:
        chosen = TableSelector.of((self.rows, self.cols)[axis].n, ids)
        return View(self.data, *((chosen, self.cols) if axis == 0 else (self.rows, chosen)), self.transforms)

    def _kept(self, ok: DataFrame, key: str, sel: Selector, axis: int) -> View:
        v = self._with(sel.apply(ok, key).select(key), axis)
        if not len((v.rows, v.cols)[axis]):
            raise ValueError("everything was filtered out")
        return v

    def compute(self) -> dict[str, Any]:
        """Matrix as an array, metadata as pandas frames."""
        return {"X": self.X.toarray(), "obs": self.obs.toPandas(), "var": self.var.toPandas()}
