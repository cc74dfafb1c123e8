"""Most similar vectors for every vector: forest candidates, exact ranking, and exact copies handled apart."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage, workers
from ..sources.partitioned import open_uri
from . import forest as rp


def nearest_vectors(
    rows: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, least: float | None = None,
    trees: int = 2, probes: int = 3, leaf_size: int = 8192, max_sample: int = 131_072, seed: int = 0,
    searched: float = 0.22, group: int = 16,
) -> DataFrame:
    """(``id``, ``neighbour``, ``cosine``, ``rank``): up to ``k`` most similar other vectors, ties by smaller id.

    An id counts once. Rows with an unusable vector (null, other length, not finite, all zero) take no part. ``least``
    leaves out neighbours with a smaller cosine; ranks are not changed by it. Ids with the very same vector are
    searched once and then expanded: an id of such a group gets its copies first, the group's ids being ranked with a
    group limit, so a group of any size costs at most ``k`` + 1 rows per id. Empty tables give an empty result.

    ``probes`` visits are the fewest: they grow with the leaves of a tree, so that every vector is compared with about
    the share ``searched`` of the collection at any size; distant neighbours are found no other way. Pairs with a
    cosine of at least 0.9 (``least``) lie behind near boundaries and need no such growth. Visits to a subtree of up to
    ``group`` leaves travel as one row.
    """
    vectors = rp.usable_vectors(rows, id_col, vec_col, dim)
    forest = rp.build(vectors, dim, trees, leaf_size, max_sample, seed)
    if least is None or least < 0.9:
        probes = max(probes, math.ceil(searched * forest.leaves()))
    else:
        group = 0
    placed = rp.place(vectors, forest, dim, probes, group)

    def search(t):
        import pyarrow as pa

        a, b, s = rp.group_neighbours(t, dim, k, least) if group else rp.leaf_neighbours(*rp.merge_copies(t, dim), k, least)
        if not len(a):
            return pa.table({"a": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("d", pa.float64()), ("b", pa.int64())])))})
        order = np.argsort(a, kind="stable")
        a, b, s = a[order], b[order], s[order]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(a)), pa.int32()), pa.StructArray.from_arrays([pa.array(-s), pa.array(b)], names=["d", "b"]))
        return pa.table({"a": a[starts], "near": near})

    found = placed.groupBy("leaves" if group else "leaf").applyInArrow(search, "a bigint, near array<struct<d:double,b:bigint>>")
    # at most k entries per vector and leaf or subtree visited; the same pair from two leaves has the same exact cosine
    merged = found.groupBy("a").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))

    ids = rp.members(vectors)
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id")))
    first = ranked.filter(F.col("r") <= k + 1)  # the first k + 1 ids of every distinct vector
    lists = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("copies"))
    lists = lists.select("h1", "h2", F.col("copies")[0].alias("rep"), "copies")
    groups = lists.filter(F.size("copies") > 1)
    pairs = merged.select("a", F.explode("near").alias("n")).select("a", F.col("n.b").alias("b"), F.col("n.d").alias("d"))
    # neighbours that stand for several ids
    many = groups.select(F.col("rep").alias("b2"), F.col("copies").alias("ids"))
    pairs = pairs.join(many, pairs["b"] == many["b2"], "left").select("a", "d", F.explode(F.coalesce("ids", F.array("b"))).alias("b"))
    # vectors that stand for several ids: each gets the neighbours, and its copies at distance -1 (cosine 1)
    of = ids.join(groups.select("h1", "h2", "rep", "copies"), ["h1", "h2"]).select("id", "rep", "copies")
    expanded = pairs.join(of.select(F.col("id").alias("own"), "rep"), pairs["a"] == F.col("rep"), "left").select(F.coalesce("own", "a").alias("id"), F.col("b").alias("neighbour"), "d")
    copies = of.select("id", F.explode("copies").alias("neighbour"), F.lit(-1.0).alias("d")).filter("id <> neighbour")
    every = expanded.unionByName(copies).filter("id <> neighbour")
    w = Window.partitionBy("id").orderBy("d", "neighbour")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "neighbour", (-F.col("d")).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def similar_pairs(near: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs in which one is among the other's neighbours with a cosine of at least ``least``."""
    p = near.filter(F.col("cosine") >= least)
    return p.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def exact_neighbours(rows: DataFrame, id_col: str, vec_col: str, asked, dim: int = 64, k: int = 10, block: int = 4096) -> DataFrame:
    """(``id``, ``neighbour``, ``cosine``, ``rank``) by brute force for the rows that meet ``asked``, against all rows.

    The measure of what the forest finds. The asked vectors are staged in files of about ``block`` rows; every task compares its part
    of the rows with one file after another, so neither is sent to the driver or to every executor at once. Nulls,
    unusable vectors, ties and repeated ids as in :func:`nearest_vectors`.
    """
    spark = rows.sparkSession
    workers(spark)
    vectors = rp.usable_vectors(rows, id_col, vec_col, dim)
    some = rp.usable_vectors(rows.filter(asked), id_col, vec_col, dim).dropDuplicates(["id"])
    staged = stage(some.repartition(max(1, math.ceil(some.count() / block)), "id"), "asked")
    files = staged.inputFiles()
    wide = k + 16

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        t = pa.Table.from_batches(list(batches), schema=pa.schema([("id", pa.int64()), ("vec", pa.binary())])).combine_chunks()
        if not t.num_rows:
            return
        ids, x64 = t.column("id").to_numpy(), rp.unit(rp.as_matrix(t.column("vec"), dim))
        y = np.ascontiguousarray(x64.astype(np.float32).T)
        for uri in files:
            system, path = open_uri(uri)
            with system.open_input_file(path) as f:
                q = pq.read_table(f, columns=["id", "vec"])
            qid, q64 = q.column("id").to_numpy(), rp.unit(rp.as_matrix(q.column("vec").combine_chunks(), dim)) if q.num_rows else np.zeros((0, dim))
            step, w = rp.block_rows(len(ids)), min(wide, len(ids))
            for at in range(0, len(qid), step):
                s = q64[at : at + step].astype(np.float32) @ y
                c = np.argpartition(s, len(ids) - w, axis=1)[:, len(ids) - w :].ravel()
                r = np.repeat(np.arange(at, at + len(s)), w)
                keep = qid[r] != ids[c]
                r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_pydict({"id": qid[r], "neighbour": ids[c], "cosine": np.einsum("ij,ij->i", q64[r], x64[c])})

    pairs = vectors.mapInArrow(run, "id bigint, neighbour bigint, cosine double").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``n_pairs`` of ``exact`` (id, neighbour, cosine), the share of them that ``found`` has, and the same above cosine 0.86.

    An exact neighbour counts as found too if ``found`` has as good a one in its place (equal cosine up to 1e-9).
    """
    last = found.groupBy(F.col("id").alias("i")).agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("m"))
    have = found.select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    j = exact.join(have, (exact["id"] == have["a"]) & (exact["neighbour"] == have["b"]), "left").join(last, exact["id"] == last["i"], "left")
    hit = F.col("b").isNotNull() | F.coalesce(F.abs(F.col("cosine") - F.col("least")) < 1e-9, F.lit(False))
    near = F.col("cosine") >= 0.86
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(hit.cast("double")).alias("recall"), F.avg(F.when(near, hit.cast("double"))).alias("recall_near"))
