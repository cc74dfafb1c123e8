"""Complete groups from a stream of rows whose groups may be split over files and micro-batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..session import scratch_path, stage, workers


def file_stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """A stream over Parquet files, ``files_per_batch`` files per micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is available into a table of the shared folder and read that; of "complete" results the last."""
    spark = stream.sparkSession
    path, mark = scratch_path(spark, "stream"), checkpoint or scratch_path(spark, "streammark")
    if mode == "append":
        run_to_parquet(stream, path, mark)
        return spark.read.schema(stream.schema).parquet(path)
    last: list[int] = []

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{i}")
        last[:] = [i]

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is available into a Parquet folder."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_foreach(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Hand every micro-batch to ``handle(batch, id)``."""
    w = stream.writeStream.foreachBatch(handle).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()


def complete_groups(stream: DataFrame, expected: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """(group, items, values): each group once, as soon as as many rows came as ``expected`` (group, n) says.

    Rows of unfinished groups are kept in the keyed state; groups that ``expected`` lacks are never emitted. Lists are
    ordered by item, then value.
    """
    workers(stream.sparkSession)
    need = expected.select(F.col(group).alias("__g"), F.col("n").cast("bigint").alias("__n"))
    rows = stream.select(group, F.col(item).cast("bigint").alias("item"), F.col(value).cast("double").alias("value"))
    joined = rows.join(need, rows[group] == need["__g"]).select(group, "item", "value", "__n")
    kind = dict(joined.dtypes)[group]

    def collect(key, frames, state: GroupState):
        items, values = (list(x) for x in state.get) if state.exists else ([], [])
        n = 0
        for f in frames:
            items += f["item"].tolist()
            values += f["value"].tolist()
            n = int(f["__n"].iloc[0]) if len(f) else n
        if n and len(items) >= n:
            state.remove()
            both = sorted(zip(items, values))
            yield pd.DataFrame({group: [key[0]], "items": [[i for i, _ in both]], "values": [[v for _, v in both]]})
        else:
            state.update((items, values))

    return joined.groupBy(group).applyInPandasWithState(collect, f"`{group}` {kind}, items array<bigint>, values array<double>", "items array<bigint>, values array<double>", "append", GroupStateTimeout.NoTimeout)


def groups_by_position(stream: DataFrame, group: str, item: str, value: str, path: str, checkpoint: str) -> DataFrame:
    """(group, items, values): groups of a stream whose files come in group order, without knowing their sizes.

    A micro-batch's last group may go on in the next one, so it is withheld there and released when a higher group comes,
    or at the end. Withheld rows are a table below ``checkpoint``, one version per micro-batch, so a batch that is run
    again finds what it found before and writes the same files. Lists are ordered by item, then value.
    """
    spark = stream.sparkSession
    rows = stream.select(group, F.col(item).cast("bigint").alias("item"), F.col(value).cast("double").alias("value"))
    entry = F.array_sort(F.collect_list(F.struct("item", "value")))
    pack = lambda d: d.groupBy(group).agg(entry.alias("x")).select(group, F.col("x.item").alias("items"), F.col("x.value").alias("values"))
    kept = lambda i: f"{checkpoint}/held/{i}"
    last: list[int] = []

    def step(batch: DataFrame, i: int) -> None:
        batch = batch if i == 0 else batch.unionByName(spark.read.schema(rows.schema).parquet(kept(i - 1)))
        batch = stage(batch, "batch")  # read three times
        top = batch.agg(F.max(group)).first()[0]
        pack(batch.filter(F.col(group) < F.lit(top))).write.mode("overwrite").parquet(f"{path}/batch={i}")
        batch.filter((F.col(group) == F.lit(top)) | F.col(group).isNull()).write.mode("overwrite").parquet(kept(i))
        last[:] = [i]

    run_foreach(rows, step, f"{checkpoint}/stream")
    if last:
        pack(spark.read.schema(rows.schema).parquet(kept(last[0]))).write.mode("overwrite").parquet(f"{path}/batch={last[0] + 1}")
        return spark.read.parquet(path).drop("batch")
    return pack(spark.createDataFrame([], rows.schema))


def windowed_counts(stream: DataFrame, ts: str, late: str = "1 hour", width: str = "1 hour", slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per event-time window with a watermark; an extension for event streams."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
