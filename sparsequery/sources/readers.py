"""Foreign formats: detection, discovery, Matrix Market folders, and guarded readers for HDF5 and array stores."""

from __future__ import annotations

import os
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hdf5 import read_10x_h5, read_h5ad

FORMATS = ("parquet", "mtx", "h5ad", "h5", "tiledb")


def detect_format(path: str) -> str:
    """Format of a local file or folder; ValueError if it is none that is known."""
    p = path.rstrip("/")
    if p.endswith(".h5ad"):
        return "h5ad"
    if p.endswith((".h5", ".hdf5")):
        return "h5"
    if p.endswith(".tiledb") or os.path.isdir(f"{p}/__schema") or os.path.isdir(f"{p}/ms"):
        return "tiledb"
    if os.path.isdir(p):
        if any(glob(f"{p}/matrix.mtx*")):
            return "mtx"
        if os.path.exists(f"{p}/expression.parquet"):
            return "parquet"
    raise ValueError(f"unknown format: {path}")


def discover(path: str) -> tuple[list[str], str]:
    """Sorted inputs below ``path`` and their common format; mixed formats raise ValueError."""
    try:
        return [path], detect_format(path)
    except ValueError:
        if not os.path.isdir(path):
            raise
    found: dict[str, str] = {}
    for folder, dirs, files in os.walk(path):
        for name in [*dirs, *files]:
            p = os.path.join(folder, name)
            try:
                found[p] = detect_format(p)
            except ValueError:
                pass
        dirs[:] = [x for x in dirs if os.path.join(folder, x) not in found]
    kinds = set(found.values())
    if len(kinds) != 1:
        raise ValueError(f"{path}: " + ("no input found" if not kinds else f"several formats: {', '.join(sorted(kinds))}"))
    return sorted(found), kinds.pop()


def _lines(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """(pos, line) of the first file that exists, plain or gzipped; pos counts from 0."""
    for n in names:
        for p in (f"{folder}/{n}", f"{folder}/{n}.gz"):
            if os.path.exists(p):
                raw = spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
                return raw.filter(F.length("line") > 0)
    raise FileNotFoundError(f"{folder}: none of {', '.join(names)}")


def read_mtx(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """cells, genes and expression of a Matrix Market folder (genes by cells, counted from 1)."""
    cells = _lines(spark, folder, "barcodes.tsv").select(F.col("pos").cast("bigint").alias("cell_integer_id"), F.col("line").alias("cell_id"))
    g = _lines(spark, folder, "features.tsv", "genes.tsv").select("pos", F.split("line", "\t").alias("f"))
    genes = g.select(F.col("pos").cast("int").alias("gene_integer_id"), F.col("f")[0].alias("gene_id"), F.coalesce(F.try_element_at("f", F.lit(2)), F.col("f")[0]).alias("gene_symbol"))
    p = next(x for x in (f"{folder}/matrix.mtx", f"{folder}/matrix.mtx.gz") if os.path.exists(x))
    body = spark.read.text(p).filter(~F.col("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    sizes = body.first()["f"]  # the first line that is no comment: genes, cells, entries
    head = F.array(*(F.lit(x) for x in sizes))
    # entries equal to the size line can't occur: its third number exceeds any place only if there is a single entry
    numbered = body.withColumn("__i", F.monotonically_increasing_id())
    at = numbered.filter(F.col("f") == head).agg(F.min("__i")).first()[0]
    e = numbered.filter(F.col("__i") != F.lit(at)).select((F.col("f")[1].cast("bigint") - 1).alias("cell_integer_id"), (F.col("f")[0].cast("int") - 1).alias("gene_integer_id"), F.col("f")[2].cast("double").alias("value"))
    return {"cells": cells, "genes": genes, "expression": e}


def write_mtx(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a small dataset as a Matrix Market folder (for exchange; runs on the driver)."""
    os.makedirs(folder, exist_ok=True)
    c = tables["cells"].orderBy("cell_integer_id").toPandas()
    g = tables["genes"].orderBy("gene_integer_id").toPandas()
    e = tables["expression"].orderBy("cell_integer_id", "gene_integer_id").toPandas()
    open(f"{folder}/barcodes.tsv", "w").write("".join(f"{x}\n" for x in c.cell_id))
    open(f"{folder}/features.tsv", "w").write("".join(f"{x}\t{x}\n" for x in g.gene_id))
    with open(f"{folder}/matrix.mtx", "w") as f:
        f.write(f"%%MatrixMarket matrix coordinate real general\n{len(g)} {len(c)} {len(e)}\n")
        f.writelines(f"{j + 1} {i + 1} {v:g}\n" for i, j, v in zip(e.cell_integer_id, e.gene_integer_id, e.value))


def read_parquet_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Whatever of the known tables stands in a folder as <name>.parquet."""
    names = [n for n in ("cells", "genes", "expression", "layers", "cellsxcells", "genesxgenes") if os.path.exists(f"{folder}/{n}.parquet")]
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_tiledb(spark: SparkSession, path: str, collection: str = "RNA", layer: str = "data", ranges: int = 16) -> dict[str, DataFrame]:
    """cells, genes and expression of a sparse array store, read in contiguous ranges of rows."""
    try:
        import tiledbsoma
    except ImportError as e:
        raise ImportError("reading array stores needs the tiledbsoma library") from e
    with tiledbsoma.Experiment.open(path) as x:
        n = x.obs.count
        obs = x.obs.read().concat().to_pandas()
        var = x.ms[collection].var.read().concat().to_pandas()
    step = max(1, -(-n // ranges))

    def load(batches):
        for b in batches:
            for start in b.column(0).to_pylist():
                with tiledbsoma.Experiment.open(path) as x:
                    t = x.ms[collection].X[layer].read((slice(start, min(start + step, n) - 1), slice(None))).tables().concat()
                    yield from t.rename_columns(["cell_integer_id", "gene_integer_id", "value"]).to_batches()

    return {
        "cells": spark.createDataFrame(obs.assign(cell_integer_id=range(len(obs)))),
        "genes": spark.createDataFrame(var.assign(gene_integer_id=range(len(var)))),
        "expression": spark.range(0, n, step).mapInArrow(load, "cell_integer_id bigint, gene_integer_id bigint, value double"),
    }


def read_any(spark: SparkSession, path: str, fmt: str = "auto") -> dict[str, DataFrame]:
    """Tables of an input of any known format."""
    f = detect_format(path) if fmt == "auto" else fmt
    if f not in FORMATS:
        raise ValueError(f"unknown format {f!r}")
    return {"parquet": read_parquet_folder, "mtx": read_mtx, "h5ad": read_h5ad, "h5": read_10x_h5, "tiledb": read_tiledb}[f](spark, path)


def parse_hub_path(path: str) -> tuple[str, str]:
    """(repository, path inside) of ``hf://datasets/user/repo/rest``."""
    parts = path.removeprefix("hf://").split("/")
    if not path.startswith("hf://") or len(parts) < 3 or parts[0] != "datasets":
        raise ValueError(f"not a dataset address: {path}")
    return "/".join(parts[1:3]), "/".join(parts[3:])


def synthetic(spark: SparkSession, n_cells: int, n_genes: int, density: float = 0.05, seed: int = 0) -> dict[str, DataFrame]:
    """A random dataset: each row id draws about density * n_genes column ids; log-normal counts of at least 1."""
    k = max(1, round(density * n_genes))
    c = spark.range(n_cells).withColumnRenamed("id", "cell_integer_id")
    e = c.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    pick = F.pmod(F.xxhash64("cell_integer_id", "__j", F.lit(seed)), F.lit(n_genes)).cast("int")
    u = (F.pmod(F.xxhash64("cell_integer_id", "__j", F.lit(seed + 1)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    e = e.select("cell_integer_id", pick.alias("gene_integer_id"), (F.floor(F.exp(F.sqrt(-2 * F.log(u)))) + 1).cast("double").alias("value")).dropDuplicates(["cell_integer_id", "gene_integer_id"])
    types = F.array(*(F.lit(f"type_{i}") for i in range(6)))
    cells = c.select("cell_integer_id", F.concat(F.lit("cell_"), F.col("cell_integer_id").cast("string")).alias("cell_id"), types[F.pmod(F.xxhash64("cell_integer_id", F.lit(seed + 2)), F.lit(6)).cast("int")].alias("cell_type"))
    genes = spark.range(n_genes).select(F.col("id").cast("int").alias("gene_integer_id"), F.concat(F.lit("gene_"), F.col("id").cast("string")).alias("gene_id"))
    return {"cells": cells, "genes": genes, "expression": e}
