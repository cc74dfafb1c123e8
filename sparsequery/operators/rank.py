"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage, workers


def _number(batches):
    import pyarrow as pa

    n = 0
    for b in batches:
        i = pa.array(range(n, n + b.num_rows), pa.int64())
        n += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, i], names=[*b.schema.names, "__sq_i"])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0-based position in ``order`` over all rows.

    Range-partitions once, numbers rows inside each partition and adds the partition's offset, so no task holds more
    than its range. The numbered table is staged: the offsets and the rows come from one and the same partitioning.
    ``order`` should be total; ties get an arbitrary but consistent order. An empty table stays empty.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    workers(df.sparkSession)
    pid, i = "__sq_pid", "__sq_i"
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(pid, F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField(i, T.LongType())])
    numbered = stage(ranged.mapInArrow(_number, schema), "rank")
    sizes = numbered.groupBy(pid).agg(F.count(F.lit(1)).alias("__sq_c"))  # one row per partition
    offsets = sizes.select(pid, (F.sum("__sq_c").over(Window.orderBy(pid)) - F.col("__sq_c")).alias("__sq_o"))
    return numbered.join(F.broadcast(offsets), pid).withColumn(name, F.col(i) + F.col("__sq_o")).drop(pid, i, "__sq_o")
