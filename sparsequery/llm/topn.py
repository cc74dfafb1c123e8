"""Top N items within every group by statistics-guided skipping.

The rows are written as files clustered by group (range partitions of group and score, so that a group of any size is
spread over files) and sorted by descending score inside a file, in small row groups. A reader task takes one file's row
groups in descending order of their maximum score and skips those whose maximum is strictly below the current N-th score
of every group they contain (or equal to it: equal scores are sorted by item, so later ones come too late). Which groups these are the statistics tell (one group, or a range of integers that all have
their N-th score); where they leave it open, the group column alone is read first. What the files keep, at most N rows
per group and file, is merged with a group-limited window.

Skipping pays where groups are much larger than N. Of groups with little more than N rows most rows are the answer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_path, workers
from ..sources.partitioned import open_uri


def current_values(expression: DataFrame) -> DataFrame:
    """(cell_integer_id, gene_integer_id, value): of each pair the usable value with the latest ``loaded_at``.

    Usable: not null, not NaN, above 0. Of several usable values of one ``loaded_at`` the largest counts; a null
    ``loaded_at`` is the earliest. Repeated rows merge before the shuffle.
    """
    v = F.col("value").cast("double")
    ok = expression.filter(v.isNotNull() & ~F.isnan(v) & (v > 0))
    best = ok.groupBy("cell_integer_id", "gene_integer_id").agg(F.max(F.struct("loaded_at", v.alias("value"))).alias("b"))
    return best.select("cell_integer_id", "gene_integer_id", F.col("b.value").alias("value"))


def read_top(uri: str, n: int, stats: dict | None = None) -> Iterator:
    """Batches (g, s, i) of one clustered file (sorted by s descending, then g and i) with every group's first ``n`` rows of it.

    ``stats`` counts row groups: ``read``, ``skipped`` by statistics, ``passed`` over after a look at their group column.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    stats = {} if stats is None else stats

    def count(what):
        stats[what] = stats.get(what, 0) + 1

    system, path = open_uri(uri)
    with system.open_input_file(path) as f:
        pf = pq.ParquetFile(f)
        names = pf.schema_arrow.names
        g, s = names.index("g"), names.index("s")
        whole = pa.types.is_integer(pf.schema_arrow.field("g").type)
        meta = [pf.metadata.row_group(i) for i in range(pf.num_row_groups)]

        def bounds(i, c):
            st = meta[i].column(c).statistics
            return (st.min, st.max) if st is not None and st.has_min_max else (None, None)

        top = {i: bounds(i, s)[1] for i in range(len(meta))}
        seen: dict = {}  # group -> its rows so far
        nth: dict = {}  # group -> its N-th best score; only groups that have N
        done = np.zeros(0)  # sorted integer groups in nth, as of some time ago

        for i in sorted(top, key=lambda i: (-np.inf if top[i] is None else -top[i], i)):
            lo, hi = bounds(i, g)
            full = lambda k, m=top[i]: m is not None and m <= nth.get(k, -np.inf)
            if lo is not None and lo == hi and full(lo):
                count("skipped")
                continue
            if whole and lo is not None and hi - lo < len(nth):
                if len(done) != len(nth):
                    done = np.sort(np.fromiter(nth, np.int64, len(nth)))
                inside = done[np.searchsorted(done, lo) : np.searchsorted(done, hi, "right")]
                if len(inside) == hi - lo + 1 and all(full(k) for k in inside.tolist()):
                    count("skipped")
                    continue
            coded = pf.read_row_group(i, columns=["g"]).column("g").combine_chunks().dictionary_encode()
            if not len(coded):
                continue
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            groups = coded.dictionary.to_pylist()
            if all(full(k) for k in groups):
                count("passed")
                continue
            count("read")
            t = pf.read_row_group(i, columns=["g", "s", "i"]).combine_chunks()
            scores, codes = t.column("s").to_numpy(), coded.indices.to_numpy()
            if (np.diff(scores) > 0).any():
                raise ValueError(f"{uri} is not sorted by score")
            order = np.argsort(codes, kind="stable")
            sizes = np.bincount(codes, minlength=len(groups))
            before = np.fromiter((seen.get(k, 0) for k in groups), np.int64, len(groups))
            place = np.empty(len(codes), np.int64)
            place[order] = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place += before[codes]
            for c, k in enumerate(groups):
                seen[k] = int(before[c] + sizes[c])
            last = np.flatnonzero(place == n - 1)
            nth.update(zip((groups[c] for c in codes[last].tolist()), scores[last].tolist()))
            yield from t.filter(pa.array(place < n)).to_batches()


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, row_group_rows: int = 8192, files: int | None = None, stats: dict | None = None) -> DataFrame:
    """(group, item, score, ``rank``): per group the first ``n`` rows by score descending, then item ascending.

    Rows with a null group or item and rows whose score is null or NaN are left out; repeated rows are items of their
    own; an empty table gives an empty result. Groups may have any number of rows. ``stats`` gets accumulators that
    count row groups when the result is evaluated (see :func:`read_top`).
    """
    spark = rows.sparkSession
    workers(spark)
    src = rows.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(item).alias("i"))
    src = src.filter("g is not null and i is not null and s is not null and not isnan(s)")
    width = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "clustered")
    clustered = src.repartitionByRange(width, F.col("g"), F.col("s").desc(), F.col("i")).sortWithinPartitions(F.col("s").desc(), F.col("g"), F.col("i"))
    clustered.write.option("parquet.block.row.count.limit", str(row_group_rows)).parquet(path)
    names = spark.read.schema(src.schema).parquet(path).inputFiles()
    counters = {k: spark.sparkContext.accumulator(0) for k in ("read", "skipped", "passed")}
    if stats is not None:
        stats.update(counters)

    def run(batches: Iterable) -> Iterator:
        for b in batches:
            for uri in b.column(0).to_pylist():
                own: dict = {}
                yield from read_top(uri, n, own)
                for k, v in own.items():
                    counters[k].add(v)

    schema = T.StructType([src.schema["g"], src.schema["s"], src.schema["i"]])
    if not names:
        kept = spark.createDataFrame([], schema)
    else:
        listed = spark.createDataFrame([(x,) for x in names], "file string").repartitionByRange(min(len(names), 4096), "file")
        kept = listed.mapInArrow(run, schema)
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i"))
    first = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return first.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("rank").cast("bigint").alias("rank"))
