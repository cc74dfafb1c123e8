"""Matrices in HDF5 files: annotated matrices with all their parts, and feature-by-barcode matrices.

Everything is read through ``opener(path)``, a context manager with the interface of an h5py file; tests give another
one. Metadata is read on the driver (one row per cell or gene), the matrices in chunks by the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partitioned import read_source

CELL, GENE, VALUE = "cell_integer_id", "gene_integer_id", "value"


def h5py_opener(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 files needs the h5py library") from e
    return h5py.File(path, "r")


def _text(x) -> Any:
    return x.decode() if isinstance(x, bytes) else x.item() if isinstance(x, np.generic) else x


def _attr(node, name: str, default=None):
    return _text(node.attrs[name]) if name in node.attrs else default


def _is_group(node) -> bool:
    return hasattr(node, "keys") and not hasattr(node, "dtype")


class MatrixChunks:
    """(row, column, value) of one stored matrix in chunks: compressed rows, compressed columns or dense.

    A compressed matrix is cut along its compressed axis. Stored zeros and NaN are left out, as absent pairs are zeros.
    """

    def __init__(self, path: str, node: str, opener: Callable, chunk: int = 25_000, names: tuple[str, str] = (CELL, GENE), by_column: bool | None = None):
        self.path, self.node, self.opener, self.chunk, self.names = path, node, opener, chunk, names
        with opener(path) as f:
            x = f[node]
            if _is_group(x):
                kind = str(_attr(x, "encoding-type", _attr(x, "h5sparse_format", "csr")))
                self.kind = "columns" if (kind.startswith("csc") if by_column is None else by_column) else "rows"
                self.size = len(x["indptr"]) - 1
            else:
                self.kind, self.size = "dense", x.shape[0]

    def ddl(self) -> str:
        return f"`{self.names[0]}` bigint, `{self.names[1]}` {'int' if self.names[1] == GENE else 'bigint'}, {VALUE} double"

    def partition_count(self) -> int:
        return -(-self.size // self.chunk)

    def read(self, partition: int, batch_rows: int = 64_000) -> Iterator:
        import pyarrow as pa

        a, b = partition * self.chunk, min((partition + 1) * self.chunk, self.size)
        with self.opener(self.path) as f:
            x = f[self.node]
            if self.kind == "dense":
                block = np.asarray(x[a:b])
                row, col = np.nonzero(block)
                value, row = block[row, col], row + a
            else:
                ptr = np.asarray(x["indptr"][a : b + 1]).astype(np.int64)
                own, other = np.repeat(np.arange(a, b), np.diff(ptr)), np.asarray(x["indices"][ptr[0] : ptr[-1]])
                value = np.asarray(x["data"][ptr[0] : ptr[-1]])
                row, col = (own, other) if self.kind == "rows" else (other, own)
        value = value.astype(np.float64)
        keep = (value != 0) & ~np.isnan(value)
        row, col, value = row[keep].astype(np.int64), col[keep].astype(np.int32 if self.names[1] == GENE else np.int64), value[keep]
        for at in range(0, len(value), batch_rows):
            s = slice(at, at + batch_rows)
            yield pa.RecordBatch.from_arrays([pa.array(row[s]), pa.array(col[s]), pa.array(value[s])], names=[*self.names, VALUE])


def read_column(node) -> list:
    """One metadata column: plain values, or categories with codes (-1 is null)."""
    if _is_group(node):
        if "categories" in node:
            kinds, codes = [_text(x) for x in node["categories"][:]], np.asarray(node["codes"][:])
            return [None if c < 0 else kinds[c] for c in codes.tolist()]
        values, mask = [_text(x) for x in node["values"][:]], np.asarray(node["mask"][:]).tolist()
        return [None if m else v for v, m in zip(values, mask)]
    out = [_text(x) for x in node[:]]
    return [None if isinstance(x, float) and x != x else x for x in out]


def read_frame(node, key: str, name: str) -> dict[str, list]:
    """Columns of a metadata table, its index as ``name`` and the row numbers as ``key``; lists of different length are an error."""
    if not _is_group(node):  # a table of compound rows, as older files have it
        table = node[:]
        first = next((c for c in ("index", "_index") if c in table.dtype.names), table.dtype.names[0])
        cols = {name if c == first else c: [_text(x) for x in table[c]] for c in table.dtype.names}
    else:
        index = _attr(node, "_index", next((c for c in ("_index", "index") if c in node), None))
        cols = {name if c == index else c: read_column(node[c]) for c in node.keys() if not c.startswith("__")}
    n = {len(v) for v in cols.values()}
    if len(n) > 1:
        raise ValueError(f"columns of different length: {sorted(n)}")
    return {key: list(range(n.pop() if n else 0)), **{c.replace(".", "_"): v for c, v in cols.items()}}


def _frame(spark: SparkSession, cols: dict[str, list], key: str) -> DataFrame:
    import pandas as pd

    d = pd.DataFrame({c: pd.Series(v, dtype=object if any(isinstance(x, (str, bool)) or x is None for x in v) else None) for c, v in cols.items()})
    d = d.astype({key: "int64"})
    empty = [c for c in d.columns if d[c].isna().all()]
    out = spark.createDataFrame(d.drop(columns=empty))
    for c in empty:
        out = out.withColumn(c, F.lit(None).cast("string"))
    return out.withColumn(key, F.col(key).cast("int" if key == GENE else "bigint"))


def _vectors(spark: SparkSession, node, key: str) -> Iterator[tuple[str, DataFrame]]:
    for name in node.keys():
        x = node[name]
        if not _is_group(x) and len(x.shape) == 2:
            rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.asarray(x[:]))]
            yield name, spark.createDataFrame(rows, f"{key} bigint, `{name}` array<float>")


def _wide(parts: dict[str, DataFrame], keys: tuple[str, str]) -> DataFrame | None:
    """Triples of several matrices side by side: a row per pair that any of them stores."""
    long = None
    for n, d in parts.items():
        d = d.select(*keys, F.lit(n).alias("__k"), VALUE)
        long = d if long is None else long.unionByName(d)
    return None if long is None else long.groupBy(*keys).agg(*(F.max(F.when(F.col("__k") == n, F.col(VALUE))).alias(n) for n in parts))


def read_h5ad(spark: SparkSession, path: str, chunk: int = 25_000, opener: Callable = h5py_opener) -> dict[str, DataFrame]:
    """All parts of an annotated matrix: cells and genes with their columns and vectors, expression, layers, pairwise tables.

    Names are made up (cell_0, ...) where the index is missing. Parts that the file lacks give no table.
    """
    with opener(path) as f:
        cols = {n: read_frame(f[n], key, name) if n in f else {} for n, key, name in (("obs", CELL, "cell_id"), ("var", GENE, "gene_id"))}
        layers = list(f["layers"].keys()) if "layers" in f else []
        pairs = {n: list(f[n].keys()) if n in f else [] for n in ("obsp", "varp")}
        x = f["X"]
        shape = x.shape if not _is_group(x) else tuple(int(v) for v in (x.attrs["shape"] if "shape" in x.attrs else x.attrs["h5sparse_shape"]))
        for n, key, name, size in (("obs", CELL, "cell_id", shape[0]), ("var", GENE, "gene_id", shape[1])):
            cols[n] = cols[n] or {key: list(range(size))}
            cols[n].setdefault(name, [f"{name[:4]}_{i}" for i in range(size)])
            if len(cols[n][key]) != size:
                raise ValueError(f"{path}: {n} has {len(cols[n][key])} rows, the matrix {size}")
        out = {"cells": _frame(spark, cols["obs"], CELL), "genes": _frame(spark, cols["var"], GENE)}
        for table, node, key in (("cells", "obsm", CELL), ("genes", "varm", GENE)):
            for name, v in _vectors(spark, f[node], key) if node in f else ():
                v = v.withColumnRenamed(key, "__k")
                out[table] = out[table].drop(name).join(v, F.col(key) == F.col("__k"), "left").drop("__k")
    matrix = lambda node, names=(CELL, GENE): read_source(spark, MatrixChunks(path, node, opener, chunk, names))
    out["expression"] = matrix("X")
    if layers:
        out["layers"] = _wide({n: matrix(f"layers/{n}") for n in layers}, (CELL, GENE))
    for node, table in (("obsp", "cellsxcells"), ("varp", "genesxgenes")):
        if pairs[node]:
            out[table] = _wide({n: matrix(f"{node}/{n}", ("id_i", "id_j")) for n in pairs[node]}, ("id_i", "id_j"))
    return out


def read_uns(path: str, opener: Callable = h5py_opener) -> dict:
    """The unstructured values of an annotated matrix, as what JSON can hold."""

    def value(node):
        if _is_group(node):
            return {k: value(node[k]) for k in node.keys()}
        x = node[()]
        return [_text(v) for v in x.tolist()] if isinstance(x, np.ndarray) and x.ndim else _text(x)

    with opener(path) as f:
        return value(f["uns"]) if "uns" in f else {}


def read_10x_h5(spark: SparkSession, path: str, chunk: int = 25_000, opener: Callable = h5py_opener) -> dict[str, DataFrame]:
    """cells, genes and expression of a feature-by-barcode matrix: under ``matrix``, under a genome's name, or dense in ``X``.

    The compressed axis is the barcodes', so a chunk is a range of cells.
    """
    with opener(path) as f:
        if "X" in f and not _is_group(f["X"]):
            n, m = f["X"].shape
            ids = lambda node, key, name, size: read_frame(f[node], key, name) if node in f else {key: list(range(size)), name: [f"{name[:4]}_{i}" for i in range(size)]}
            cells, genes, root = ids("obs", CELL, "cell_id", n), ids("var", GENE, "gene_id", m), "X"
        else:
            root = "matrix" if "matrix" in f else next((k for k in f.keys() if _is_group(f[k]) and "indptr" in f[k]), None)
            if root is None:
                raise ValueError(f"{path}: no matrix found")
            g = f[root]
            text = lambda node: [_text(x) for x in node[:]]
            barcodes = text(g["barcodes"]) if "barcodes" in g else [f"cell_{i}" for i in range(len(g["indptr"]) - 1)]
            cells = {CELL: list(range(len(barcodes))), "cell_id": barcodes}
            if "features" in g:
                feats = g["features"]
                genes = {"gene_id": text(feats["id"]), **{new: text(feats[old]) for old, new in (("name", "gene_symbol"), ("feature_type", "gene_type"), ("genome", "genome")) if old in feats}}
            elif "genes" in g:
                genes = {"gene_id": text(g["genes"]), **({"gene_symbol": text(g["gene_names"])} if "gene_names" in g else {})}
            else:
                genes = {"gene_id": [f"gene_{i}" for i in range(int(g["shape"][0]))]}
            genes = {GENE: list(range(len(genes["gene_id"]))), **genes}
    expression = read_source(spark, MatrixChunks(path, root, opener, chunk, by_column=False))
    return {"cells": _frame(spark, cells, CELL), "genes": _frame(spark, genes, GENE), "expression": expression}
