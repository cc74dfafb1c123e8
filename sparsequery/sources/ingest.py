"""Writing dataset folders: conversion, several inputs as one, appending, layers, vectors, pairwise tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_path, stage
from . import layout
from .layout import CELL, GENE, VALUE, Config
from .readers import discover, read_any


def wide_to_coo(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, gene_integer_id, value) of the non-zero, non-null entries of an array column."""
    e = rows.select(F.col(key).alias(CELL), F.posexplode(vector).alias(GENE, VALUE))
    return e.filter(F.col(VALUE).isNotNull() & (F.col(VALUE) != 0)).select(CELL, GENE, F.col(VALUE).cast("double").alias(VALUE))


def clean_metadata(df: DataFrame, key: str) -> DataFrame:
    """Column names without dots, columns of struct or map type as JSON text; a null key raises ValueError."""
    df = df.withColumnsRenamed({f"{c}": c.replace(".", "_") for c in df.columns if "." in c})
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.MapType))]
    df = df.withColumns({c: F.to_json(c) for c in nested})
    if not df.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"null in {key}")
    return df


def json_field(column: str, path: str, kind: str = "string") -> Column:
    """One value out of a column of JSON objects; null where it is missing or of another kind."""
    return F.get_json_object(column, f"$.{path}").try_cast(kind)


def narrow_type(expression: DataFrame) -> str:
    """'int' if every value is whole and within 0..65535, else 'float': how the values are stored, not computed."""
    v = F.col(VALUE).cast("double")
    bad = expression.filter(v.isNull() | F.isnan(v) | (v != F.floor(v)) | ~v.between(0, 65535))
    return "int" if bad.isEmpty() else "float"


def validate(inputs: list[dict[str, DataFrame]]) -> None:
    """All inputs need the genes, cell columns and value kind of the first; differences raise ValueError."""
    first = inputs[0]
    for i, x in enumerate(inputs[1:], 1):
        a, b = first["genes"].select("gene_id"), x["genes"].select("gene_id")
        if not gene_set_difference(a, b).isEmpty():
            raise ValueError(f"input {i}: its genes differ from those of the first input")
        if set(first["cells"].columns) != set(x["cells"].columns):
            raise ValueError(f"input {i}: its cell columns differ from those of the first input")
        kinds = [y["expression"].schema[VALUE].dataType for y in (first, x)]
        if isinstance(kinds[0], T.IntegralType) != isinstance(kinds[1], T.IntegralType):
            raise ValueError(f"input {i}: its values are of another kind")


def gene_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gene_id, side): genes that only one of two tables has."""
    left, right = a.select("gene_id").distinct(), b.select("gene_id").distinct()
    only = lambda x, y, s: x.exceptAll(y).withColumn("side", F.lit(s))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def union_inputs(inputs: list[dict[str, DataFrame]], names: list[str], offset: int = 0) -> dict[str, DataFrame]:
    """One dataset: cell ids run on from input to input, genes are the first input's, ``source_file`` names the input."""
    validate(inputs)
    genes = inputs[0]["genes"]
    by_name = genes.select("gene_id", F.col(GENE).alias("__g"))
    cells, expr = [], []
    for x, name in zip(inputs, names):
        cells.append(x["cells"].withColumn(CELL, (F.col(CELL) + F.lit(offset)).cast("bigint")).withColumn("source_file", F.lit(name)))
        own = x["genes"].select(F.col(GENE).alias("__own"), "gene_id").join(by_name, "gene_id")
        e = x["expression"].join(F.broadcast(own) if own.count() <= 200_000 else own, F.col(GENE) == F.col("__own"))
        expr.append(e.select((F.col(CELL) + F.lit(offset)).cast("bigint").alias(CELL), F.col("__g").cast("int").alias(GENE), F.col(VALUE).cast("double").alias(VALUE)))
        offset += x["cells"].count()
    union = lambda fs: reduce(DataFrame.unionByName, fs)
    return {"cells": union(cells), "genes": genes, "expression": union(expr)}


def write_dataset(tables: dict[str, DataFrame], folder: str, gene_copy: bool = True, partitions: int | None = None, uns: dict | None = None, values: str = "auto", inputs: list[str] | None = None) -> Config:
    """Write tables and config.json. The matrix is stored clustered by cell and, with ``gene_copy``, again by gene.

    ``values``: the type in which matrix values are stored; "auto" takes int where they fit, else float.

    config.json comes last and is swapped in whole: a failed write leaves no readable half dataset.
    """
    spark = tables["cells"].sparkSession
    if layout.exists(spark, f"{folder}/config.json"):
        raise FileExistsError(folder)
    # what was computed or converted is computed once: checks, range sampling and statistics read it again
    cells, genes = clean_metadata(stage(tables["cells"], "cells"), CELL), clean_metadata(stage(tables["genes"], "genes"), GENE)
    e = stage(tables["expression"].select(F.col(CELL).cast("bigint").alias(CELL), F.col(GENE).cast("int").alias(GENE), F.col(VALUE)), "matrix")
    e = e.withColumn(VALUE, F.col(VALUE).cast(narrow_type(e) if values == "auto" else values))
    if not e.filter(F.col(CELL).isNull() | F.col(GENE).isNull() | F.col(VALUE).isNull()).isEmpty():
        raise ValueError("null in the matrix")
    names = {n: layout.next_version(n, None) for n in tables}
    layout.write_clustered(e, f"{folder}/{names['expression']}", [CELL, GENE], partitions)
    stored = spark.read.schema(e.schema).parquet(f"{folder}/{names['expression']}")
    if gene_copy:
        names["expression_by_gene"] = layout.next_version("expression_by_gene", None)
        layout.write_clustered(stored, f"{folder}/{names['expression_by_gene']}", [GENE, CELL], partitions)
    named = lambda d, c: (c,) if c in d.columns else ()
    layout.write_clustered(_with_start(stored, cells), f"{folder}/{names['cells']}", [CELL], partitions, named(cells, "cell_id"))
    layout.write_clustered(genes, f"{folder}/{names['genes']}", [GENE], 1, named(genes, "gene_id"))
    for n in ("layers", "cellsxcells", "genesxgenes"):
        if n in tables:
            layout.write_clustered(tables[n], f"{folder}/{names[n]}", tables[n].columns[:2], partitions)
    shape = (cells.count(), genes.count())
    names = {n: [p] for n, p in names.items()}
    own = {"obs": {"immutable": cells.columns}, "var": {"immutable": genes.columns}, "layers": {"immutable": tables["layers"].columns[2:] if "layers" in tables else []}}
    config = Config(shape, names, layout.stats_dict(stored, shape), own, uns or {}, inputs=inputs or [])
    layout.save_config(spark, folder, config)
    return config


def _with_start(expression: DataFrame, cells: DataFrame, offset: int = 0) -> DataFrame:
    index = layout.start_index(expression, cells).select(F.col(CELL).alias("__i"), (F.col("cell_start_index") + F.lit(offset)).alias("cell_start_index"))
    return cells.drop("cell_start_index").join(index, F.col(CELL) == F.col("__i")).drop("__i")


def convert_frames(cells, genes, expression, folder: str, spark: SparkSession, **kw) -> Config:
    """Convert what is in memory: pandas frames, or a matrix (NumPy array or anything with ``tocoo``) instead of triples.

    The row and column numbers of a matrix are the ids; frames without ids are numbered in their order.
    """
    import numpy as np
    import pandas as pd

    if not isinstance(expression, pd.DataFrame):
        m = expression.tocoo() if hasattr(expression, "tocoo") else None
        row, col = (m.row, m.col) if m is not None else np.nonzero(expression)
        expression = pd.DataFrame({CELL: row, GENE: col, VALUE: m.data if m is not None else np.asarray(expression)[row, col]})
    frame = lambda d, key: spark.createDataFrame(d if key in d.columns else d.reset_index(drop=True).assign(**{key: range(len(d))}))
    e = spark.createDataFrame(expression[[CELL, GENE, VALUE]].astype({CELL: "int64", GENE: "int32", VALUE: "float64"}))
    tables = {"cells": frame(cells, CELL).withColumn(CELL, F.col(CELL).cast("bigint")), "genes": frame(genes, GENE).withColumn(GENE, F.col(GENE).cast("int")), "expression": e}
    return write_dataset(tables, folder, **kw)


def convert(spark: SparkSession, source: str | list[str], folder: str, fmt: str = "auto", on_error: str = "raise", skipped: list | None = None, resume: bool = False, **kw) -> Config:
    """Convert one input, a list, or a folder of inputs.

    ``on_error`` "skip" leaves out inputs that can't be read and adds (path, error) to ``skipped``, which must be given.
    ``resume``: each input is written for itself and recorded in config.json together with its rows, so a conversion that
    broke off goes on with the inputs that are missing. Otherwise all inputs are written at once or not at all.
    """
    if on_error == "skip" and skipped is None:
        raise ValueError("give a list for what is skipped")
    paths, found = (source, fmt) if isinstance(source, list) else discover(source)
    kind = found if fmt == "auto" and not isinstance(source, list) else fmt
    name = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    config = layout.load_config(spark, folder) if resume and layout.exists(spark, f"{folder}/config.json") else None
    inputs, names = [], []
    for p in paths:
        if config and p in config.inputs:
            continue
        try:
            tables = read_any(spark, p, kind)
        except Exception as e:
            if on_error != "skip":
                raise
            skipped.append((p, str(e)))
            continue
        if not resume:
            inputs.append(tables)
            names.append(name(p))
        elif config is None:
            config = write_dataset(union_inputs([tables], [name(p)]), folder, inputs=[p], **kw)
        else:
            config = append_tables(spark, tables, name(p), folder, p)
    if resume and config:
        return config
    if not inputs:
        raise ValueError("no input could be read")
    return write_dataset(inputs[0] if len(inputs) == 1 else union_inputs(inputs, names), folder, inputs=list(paths), **kw)


def append(spark: SparkSession, source: str, folder: str, fmt: str = "auto") -> Config:
    """Append one input to a dataset: same genes and cell columns; ids, prefix index and statistics run on."""
    return append_tables(spark, read_any(spark, source, fmt), source.rstrip("/").rsplit("/", 1)[-1], folder, source)


def append_tables(spark: SparkSession, new: dict[str, DataFrame], name: str, folder: str, source: str | None = None) -> Config:
    """Append tables to a dataset as parts of their own; nothing that is stored is read again but genes and column names.

    The parts become current when config.json is replaced. Earlier cells without a ``source_file`` get 'original_data'.
    """
    config = layout.load_config(spark, folder)
    old = {n: layout.read_table(spark, folder, config, n) for n in ("cells", "genes", "expression")}
    plain = lambda t: t.drop("source_file", "cell_start_index")
    kind = lambda e: e.withColumn(VALUE, F.col(VALUE).cast("double"))  # noqa: E731  how values are stored is no matter
    validate([{**old, "cells": plain(old["cells"]), "expression": kind(old["expression"])}, {**new, "cells": plain(new["cells"]), "expression": kind(new["expression"])}])
    # onto the stored genes' numbers, ids behind the stored ones
    by_name = {"cells": plain(new["cells"]), "genes": old["genes"], "expression": _regened(old["genes"], new)}
    more = union_inputs([by_name], [name], config.shape[0])
    stored_as = dict(old["expression"].dtypes)[VALUE]
    part = lambda n: layout.next_version(n, config.tables[n])
    parts = {n: part(n) for n in ("expression", "cells", "expression_by_gene") if n in config.tables}
    e = more["expression"]
    fits = "double" if stored_as == "double" else narrow_type(e)
    layout.write_clustered(e.withColumn(VALUE, F.col(VALUE).cast("float" if stored_as == "float" and fits == "int" else fits)), f"{folder}/{parts['expression']}", [CELL, GENE])
    stored = spark.read.parquet(f"{folder}/{parts['expression']}")
    if "expression_by_gene" in parts:
        layout.write_clustered(stored, f"{folder}/{parts['expression_by_gene']}", [GENE, CELL])
    cells = _with_start(stored, more["cells"], config.stats["expression_count"])
    layout.write_clustered(cells, f"{folder}/{parts['cells']}", [CELL])
    added = spark.read.parquet(f"{folder}/{parts['cells']}").count()
    shape = (config.shape[0] + added, config.shape[1])
    stats = layout.merge_stats(config.stats, layout.stats_dict(stored, (added, config.shape[1])), shape)
    fill = config.fill if "source_file" in old["cells"].columns else {**config.fill, "cells": {"source_file": "original_data"}}
    tables = {n: [*p, parts[n]] if n in parts else p for n, p in config.tables.items()}
    config = Config(shape, tables, stats, config.columns, config.uns, config.version, fill, [*config.inputs, source or name])
    layout.save_config(spark, folder, config)
    return config


def compact(spark: SparkSession, folder: str, partitions: int | None = None, keep_old: bool = False) -> Config:
    """Rewrite every table that appends have left in several parts as one clustered part; then delete the parts.

    ``keep_old`` leaves them for readers that opened the dataset before.
    """
    config = layout.load_config(spark, folder)
    by = {"expression": [CELL, GENE], "expression_by_gene": [GENE, CELL], "cells": [CELL], "genes": [GENE]}
    old: list[str] = []
    tables, fill = dict(config.tables), dict(config.fill)
    for n, parts in config.tables.items():
        if len(parts) < 2:
            continue
        t = layout.read_table(spark, folder, config, n)
        tables[n] = [layout.next_version(n, parts)]
        layout.write_clustered(t, f"{folder}/{tables[n][0]}", by.get(n, t.columns[:2]), partitions)
        fill.pop(n, None)
        old += parts
    config = Config(config.shape, tables, config.stats, config.columns, config.uns, config.version, fill, config.inputs)
    layout.save_config(spark, folder, config)
    if not keep_old:
        for p in old:
            drop_path(spark, f"{folder}/{p}")
    return config


def _regened(old: DataFrame, new: dict[str, DataFrame]) -> DataFrame:
    m = new["genes"].select(F.col(GENE).alias("__n"), "gene_id").join(old.select(F.col(GENE).alias("__o"), "gene_id"), "gene_id")
    e = new["expression"].join(m, F.col(GENE) == F.col("__n"))
    return e.select(CELL, F.col("__o").cast("int").alias(GENE), VALUE)


def layers_wide(expression: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """One row per pair that the matrix or a layer stores; one nullable column per layer."""
    parts = [expression.select(CELL, GENE, F.lit(None).cast("string").alias("__k"), F.lit(None).cast("double").alias("__v"))]
    parts += [d.select(CELL, GENE, F.lit(n).alias("__k"), F.col(VALUE).cast("double").alias("__v")) for n, d in layers.items()]
    long = reduce(DataFrame.unionByName, parts)
    return long.groupBy(CELL, GENE).agg(*(F.max(F.when(F.col("__k") == n, F.col("__v"))).alias(n) for n in layers))


def add_layer(layers: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """``layers`` with one more column; pairs that only ``values`` has are added."""
    if name in layers.columns:
        raise ValueError(f"there is a layer {name!r} already")
    v = values.select(F.col(CELL).alias("__c"), F.col(GENE).alias("__g"), F.col(VALUE).cast("double").alias(name))
    j = layers.join(v, (F.col(CELL) == F.col("__c")) & (F.col(GENE) == F.col("__g")), "full")
    return j.withColumns({CELL: F.coalesce(CELL, "__c"), GENE: F.coalesce(GENE, "__g")}).drop("__c", "__g")


def merge_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairwise tables side by side: every pair of either, with 0 where one has no value."""
    r = right.withColumnsRenamed({"id_i": "__i", "id_j": "__j"})
    j = left.join(r, (left["id_i"] == r["__i"]) & (left["id_j"] == r["__j"]), "full")
    keys = [c for c in [*left.columns, *right.columns] if c not in ("id_i", "id_j")]
    return j.select(F.coalesce("id_i", "__i").alias("id_i"), F.coalesce("id_j", "__j").alias("id_j"), *(F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in keys))


def add_column(dim: DataFrame, key: str, name: str, values: DataFrame, immutable: tuple[str, ...] = ()) -> DataFrame:
    """``dim`` with column ``name`` from ``values`` (key, name), replaced if it exists and isn't immutable."""
    if name in immutable or name == key:
        raise ValueError(f"{name!r} can't be changed")
    v = values.select(F.col(key).alias("__k"), F.col(name).alias("__v"))
    return dim.drop(name).join(v, F.col(key) == F.col("__k"), "left").drop("__k").withColumnRenamed("__v", name)
