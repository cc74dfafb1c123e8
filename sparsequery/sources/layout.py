"""The dataset folder: config.json and Parquet tables, written clustered and replaced by version."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL, GENE, VALUE = "cell_integer_id", "gene_integer_id", "value"


def _path(spark: SparkSession, p: str):
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    return jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jp


def exists(spark: SparkSession, p: str) -> bool:
    fs, jp = _path(spark, p)
    return fs.exists(jp)


def stamp(spark: SparkSession, p: str) -> tuple[int, int]:
    """(bytes, time of the last change) of a file or of all files of a folder; (0, 0) if there is none."""
    fs, jp = _path(spark, p)
    if not fs.exists(jp):
        return 0, 0
    parts = list(fs.listStatus(jp))
    return sum(x.getLen() for x in parts), max((x.getModificationTime() for x in parts), default=0)


def read_text(spark: SparkSession, p: str) -> str:
    fs, jp = _path(spark, p)
    if not fs.exists(jp):
        raise FileNotFoundError(p)
    stream = fs.open(jp)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, p: str, text: str) -> None:
    """Write to a neighbour first and rename it over the old file in one step, so a reader sees the old or the new text."""
    jvm = spark.sparkContext._jvm
    fs, jp = _path(spark, p)
    tmp = jvm.org.apache.hadoop.fs.Path(p + ".new")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(jp.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, jp, options)


@dataclass
class Config:
    """What a dataset folder holds. ``tables``: name -> folders of its current version, one per append.

    ``fill``: table -> column -> what stands for it in parts written before there was such a column.
    ``inputs``: the sources converted so far, in order.
    """

    shape: tuple[int, int] = (0, 0)
    tables: dict[str, list[str]] = field(default_factory=dict)
    stats: dict = field(default_factory=dict)
    columns: dict[str, dict] = field(default_factory=dict)  # family -> {"immutable": [...], "mutable": [...]}
    uns: dict = field(default_factory=dict)
    version: int = 2
    fill: dict[str, dict] = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)

    def dump(self) -> str:
        own = {"format_version": self.version, "array_shape": list(self.shape), "tables": self.tables, "metadata": self.stats, "columns": self.columns, "uns": self.uns, "fill": self.fill, "inputs": self.inputs}
        return json.dumps(own, indent=1)

    @classmethod
    def load(cls, text: str) -> Config:
        d = json.loads(text)
        tables = {n: [p] if isinstance(p, str) else p for n, p in d["tables"].items()}
        return cls(tuple(d["array_shape"]), tables, d.get("metadata", {}), d.get("columns", {}), d.get("uns", {}), 2, d.get("fill", {}), d.get("inputs", []))


def read_table(spark: SparkSession, folder: str, config: Config, name: str) -> DataFrame:
    """All parts of a table; parts whose columns or types differ are widened to one another."""
    parts = [spark.read.parquet(f"{folder}/{p}") for p in config.tables[name]]
    kinds = [dict(p.dtypes) for p in parts]
    if all(k == kinds[0] for k in kinds):
        out = parts[0] if len(parts) == 1 else spark.read.schema(parts[0].schema).parquet(*(f"{folder}/{p}" for p in config.tables[name]))
    else:
        rank = ["int", "bigint", "float", "double"]  # int and float are exact in double only
        wide = {}
        for k in kinds:
            for c, t in k.items():
                if c in wide and wide[c] != t:
                    t = "double" if {t, wide[c]} & {"float", "double"} and {t, wide[c]} <= set(rank) else "bigint" if {t, wide[c]} <= set(rank) else "string"
                wide[c] = t
        parts = [p.withColumns({c: F.col(c).cast(t) for c, t in wide.items() if c in p.columns and dict(p.dtypes)[c] != t}) for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill(config.fill[name]) if name in config.fill else out


def load_config(spark: SparkSession, folder: str) -> Config:
    return Config.load(read_text(spark, f"{folder}/config.json"))


def save_config(spark: SparkSession, folder: str, config: Config) -> None:
    write_text(spark, f"{folder}/config.json", config.dump())


def next_version(name: str, parts: list[str] | None) -> str:
    """A folder name that no version of the table has had."""
    used = [int(p.rsplit("-v", 1)[1]) for p in parts or () if "-v" in p]
    return f"{name}-v{max(used, default=0) + 1}"


def write_clustered(df: DataFrame, path: str, by: list[str], partitions: int | None = None, bloom: tuple[str, ...] = ()) -> None:
    """Range-partition and sort by ``by``, so Parquet statistics let a reader skip what an id range excludes.

    ``bloom``: columns, as names, whose values get a Bloom filter per row group for look-ups of single values.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = df.repartitionByRange(n, *by).sortWithinPartitions(*by).write
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def expression_stats(expression: DataFrame) -> DataFrame:
    """One row: count, min, max, sum, mean and sample deviation of the stored values."""
    v = F.col(VALUE).cast("double")
    return expression.agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def stats_dict(expression: DataFrame, shape: tuple[int, int]) -> dict:
    r = expression_stats(expression).first()
    cells = shape[0] * shape[1]
    density = r["count"] / cells if cells else 0.0
    return {"expression_count": r["count"], "total_possible_elements": cells, "density": density, "sparsity": 1 - density, "expression_stats": {k: r[k] for k in ("min", "max", "mean", "std")}}


def merge_stats(old: dict, new: dict, shape: tuple[int, int]) -> dict:
    """Statistics of two parts together, from those of each alone."""
    a, b = old["expression_stats"], new["expression_stats"]
    n, m = old["expression_count"], new["expression_count"]
    total, cells = n + m, shape[0] * shape[1]
    if not n or not m:
        both = b if not n else a
    else:
        gap, mean = b["mean"] - a["mean"], (a["mean"] * n + b["mean"] * m) / total
        squares = (a["std"] or 0.0) ** 2 * (n - 1) + (b["std"] or 0.0) ** 2 * (m - 1) + gap * gap * n * m / total
        both = {"min": min(a["min"], b["min"]), "max": max(a["max"], b["max"]), "mean": mean, "std": (squares / (total - 1)) ** 0.5}
    density = total / cells if cells else 0.0
    return {"expression_count": total, "total_possible_elements": cells, "density": density, "sparsity": 1 - density, "expression_stats": both}


def start_index(expression: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_integer_id, n_rows, cell_start_index): rows per id, none included, and the rows of all lower ids.

    The prefix sum is formed per range of ids and shifted by the sum of the lower ranges, not in one task.
    """
    from pyspark.sql.window import Window

    from ..session import stage

    n = expression.groupBy(F.col(CELL).alias("__c")).agg(F.count(F.lit(1)).alias("n_rows"))
    j = cells.select(CELL).distinct().join(n, F.col(CELL) == F.col("__c"), "left").select(CELL, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = stage(j.repartitionByRange(parts, CELL).withColumn("__p", F.spark_partition_id()), "index")
    sums = r.groupBy("__p").agg(F.sum("n_rows").alias("__s"))
    off = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__o"))
    own = r.withColumn("__r", F.sum("n_rows").over(Window.partitionBy("__p").orderBy(CELL).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_rows"))
    return own.join(F.broadcast(off), "__p").select(CELL, "n_rows", (F.col("__r") + F.col("__o")).alias("cell_start_index"))
