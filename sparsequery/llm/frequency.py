"""How often every term or n-gram occurs, and in how many records, from a distributed suffix array.

Occurrences: the suffixes (cut to ``max_n`` terms) are counted, range-partitioned and sorted; neighbouring suffixes
that share a prefix of length d lie in one interval of depth d, whose size is the n-gram's occurrence count.
Records: within one record's own sorted suffixes, a pair of neighbours with common prefix d is one repetition inside
the record of every n-gram up to length d, so the record count is the occurrence count less these adjacencies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage, workers


def _intervals(max_n: int, schema):
    """Common-prefix intervals over sorted (suffix, n) batches; an interval cut by a batch or partition end leaves parts."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            suffix, n = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            if not b.num_rows:
                continue
            size = pc.list_value_length(suffix).to_numpy(zero_copy_only=False)
            at = np.append(0, np.cumsum(size))[:-1]
            values = suffix.flatten()
            new = np.zeros(len(n), bool)
            new[0] = True
            for d in range(1, max_n + 1):
                has = size >= d
                if not has.any():
                    break
                v = values.take(pa.array(np.where(has, at + d - 1, 0), pa.int64(), mask=~has))
                differ = pc.not_equal(v.slice(1), v.slice(0, len(v) - 1))
                new[1:] |= pc.fill_null(differ, True).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(new)
                sums = np.add.reduceat(n, starts)
                keep = has[starts]
                starts, sums = starts[keep], sums[keep]
                grams = pa.ListArray.from_arrays(pa.array(np.arange(0, d * len(starts) + 1, d), pa.int32()), values.take(pa.array((at[starts][:, None] + np.arange(d)).ravel(), pa.int64())))
                zero = pa.array(np.zeros(len(starts), np.int64))
                yield pa.RecordBatch.from_arrays([grams, pa.array(sums, pa.int64()), zero], names=["gram", "occ", "rep"])

    return run


def ngram_frequencies(rows: DataFrame, record: str, term: str, order: list[str] | None = None, max_n: int = 1) -> DataFrame:
    """(``gram`` array, ``n_occurrences``, ``n_records``) of every n-gram up to ``max_n`` terms.

    With ``max_n`` 1 a suffix is a single term and every interval a single row; the array matters from 2 on.

    ``rows``: one per term occurrence; ``order`` gives the place in the record (needed for ``max_n`` above 1; ties are
    broken by the term). Null terms are left out; rows with a null record form one record; repeated rows are
    occurrences. Counts are combined before every shuffle, so a term with a third of all rows costs a row per task and
    record. Empty input gives an empty result.
    """
    workers(rows.sparkSession)
    cols = [F.col(record).alias("r"), F.col(term).alias("t"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order or []))]
    s = rows.select(*cols).filter(F.col("t").isNotNull())
    if max_n > 1:
        w = Window.partitionBy("r").orderBy(*(f"o{i}" for i in range(len(order or []))), "t").rowsBetween(0, max_n - 1)
        s = s.select("r", F.collect_list("t").over(w).alias("suffix"))
    else:
        s = s.select("r", F.array("t").alias("suffix"))
    own = s.groupBy("r", "suffix").agg(F.count(F.lit(1)).alias("c"))
    if max_n > 1:
        own = stage(own, "suffixes")  # read three times
    counted = own.groupBy("suffix").agg(F.sum("c").alias("n"))
    kind = counted.schema["suffix"].dataType
    schema = T.StructType([T.StructField("gram", kind), T.StructField("occ", T.LongType()), T.StructField("rep", T.LongType())])
    occurrences = counted.repartitionByRange("suffix").sortWithinPartitions("suffix").mapInArrow(_intervals(max_n, schema), schema)
    # the same suffix again in a record: adjacent and equal up to its whole length
    prefixes = lambda upto: F.explode(F.transform(F.sequence(F.lit(1), upto), lambda k: F.slice("suffix", 1, k)))
    again = own.filter(F.col("c") > 1).select(prefixes(F.size("suffix")).alias("gram"), (F.col("c") - 1).alias("rep"))
    if max_n > 1:
        # different suffixes of a record that share a prefix share their first term
        near = own.withColumn("before", F.lag("suffix").over(Window.partitionBy("r", F.col("suffix")[0]).orderBy("suffix"))).filter(F.col("before").isNotNull())
        least = F.least(F.size("suffix"), F.size("before"))
        same = F.aggregate(F.sequence(F.lit(1), F.lit(max_n)), F.lit(0), lambda acc, k: F.when((acc == k - 1) & (k <= least) & F.try_element_at("suffix", k).eqNullSafe(F.try_element_at("before", k)), k).otherwise(acc))
        again = again.unionByName(near.withColumn("lcp", same).select(prefixes(F.col("lcp")).alias("gram"), F.lit(1).cast("bigint").alias("rep")))
    rep = again.groupBy("gram").agg(F.sum("rep").alias("rep")).select("gram", F.lit(0).cast("bigint").alias("occ"), "rep")
    both = occurrences.unionByName(rep).groupBy("gram").agg(F.sum("occ").alias("n_occurrences"), F.sum("rep").alias("rep"))
    return both.select("gram", "n_occurrences", (F.col("n_occurrences") - F.col("rep")).alias("n_records"))


def mark(counts: DataFrame, n_records: int, least: float = 0.001, most: float = 0.5, column: str = "n_records") -> DataFrame:
    """``mark``: 'rare' in fewer than ``least`` of all records, 'common' in more than ``most``, else 'useful'; null counts as 0."""
    n = F.coalesce(F.col(column), F.lit(0))
    return counts.withColumn("mark", F.when(n < F.lit(least * n_records), "rare").when(n > F.lit(most * n_records), "common").otherwise("useful"))
