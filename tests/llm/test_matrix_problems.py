import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsequery.llm import frequency, percentiles, splits, topn


# top N


def pairs(spark, rows):
    return spark.createDataFrame(rows, "g bigint, i int, s double, rank int")


def test_top_n_against_a_model(spark):
    r = random.Random(0)
    rows = [(7 if j % 3 == 0 else r.randint(0, 300), r.randint(0, 10_000), float(r.randint(0, 30)), 0) for j in range(20_000)]
    rows += [(None, 1, 9.0, 0), (3, None, 9.0, 0), (3, 1, None, 0), (3, 2, float("nan"), 0), (400, 5, 1.0, 0), (400, 5, 1.0, 0)]
    got = defaultdict(list)
    for x in topn.top_n(pairs(spark, rows), "g", "i", "s", 5, row_group_rows=200).collect():
        got[x.g].append((x["rank"], x.i, x.s))
    want = defaultdict(list)
    for g, i, s, _ in rows:
        if None not in (g, i, s) and s == s:
            want[g].append((-s, i))
    assert set(got) == set(want)
    for g, x in want.items():
        assert sorted(got[g]) == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(x)[:5])]


def test_row_groups_are_skipped(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    s = np.arange(10_000, 0, -1).astype(float)
    pq.write_table(pa.table({"g": np.zeros(10_000, int), "s": s, "i": np.arange(10_000)}), tmp_path / "f.parquet", row_group_size=500)
    stats = {}
    rows = sum(b.num_rows for b in topn.read_top(f"file://{tmp_path}/f.parquet", 10, stats))
    assert rows == 10 and stats == {"read": 1, "skipped": 19}


@pytest.mark.parametrize("step", [1, 3])
def test_row_groups_with_several_groups_are_skipped(tmp_path, step):
    """Groups without gaps are skipped by statistics alone, others after a look at the group column; ties are read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    s = np.repeat(np.arange(500, 0, -1), 20).astype(float)
    g = np.arange(10_000) % 20 * step
    pq.write_table(pa.table({"g": g, "s": s, "i": np.arange(10_000)}), tmp_path / "f.parquet", row_group_size=500)
    stats = {}
    rows = sum(b.num_rows for b in topn.read_top(str(tmp_path / "f.parquet"), 25, stats))
    assert rows == 500 and stats == {"read": 1, "skipped" if step == 1 else "passed": 19}
    stats = {}
    assert sum(b.num_rows for b in topn.read_top(str(tmp_path / "f.parquet"), 26, stats)) == 520 and stats["read"] == 2


def test_a_group_of_two_million_rows(spark):
    r = spark.range(2_000_000).select((F.col("id") % 3 * 0).alias("g"), F.col("id").alias("i"), (F.xxhash64("id") % 100_000 / 7).alias("s"))
    more = spark.range(30_000).select((F.col("id") % 40 + 1).alias("g"), F.col("id").alias("i"), (F.col("id") % 11).cast("double").alias("s"))
    every, stats = r.unionByName(more), {}
    got = topn.top_n(every, "g", "i", "s", 10, files=4, stats=stats).toPandas()
    assert got.groupby("g").size().tolist() == [10] * 41
    want = [(x.i, x.s) for x in every.filter("g = 0").orderBy(F.desc("s"), "i").limit(10).collect()]
    assert [(a, b) for a, b in got[got.g == 0].sort_values("rank")[["i", "s"]].values.tolist()] == [(float(a), b) for a, b in want]
    assert stats["skipped"].value > 100 > stats["read"].value


def test_current_values(spark):
    import datetime as dt

    t = [dt.datetime(2025, 1, d) for d in (1, 2, 3)]
    e = spark.createDataFrame([(1, 1, 5.0, t[0]), (1, 1, 3.0, t[1]), (1, 1, None, t[2]), (1, 2, -1.0, t[0]), (2, 1, float("nan"), t[0]), (2, 2, 4.0, None), (2, 2, 4.0, None)], "cell_integer_id bigint, gene_integer_id int, value double, loaded_at timestamp")
    assert sorted(map(tuple, topn.current_values(e).collect())) == [(1, 1, 3.0), (2, 2, 4.0)]
    assert topn.top_n(topn.current_values(e.limit(0)), "cell_integer_id", "gene_integer_id", "value", 3).count() == 0


# percentiles


def test_percentiles_against_numpy(spark):
    r = np.random.default_rng(0)
    own = {"a": r.normal(size=4000).round(2), "b": np.repeat(3.0, 2500), "c": r.integers(0, 4, 900).astype(float), None: np.array([1.0, 2.0]), "d": np.array([5.0])}
    rows = [(g, float(v), 1) for g, x in own.items() for v in x] + [("a", None, 1), ("a", float("nan"), 1), ("none", None, 1)]
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(x.g, x.p): (x.n, x.percentile) for x in percentiles.multi_select(spark.createDataFrame(rows, "g string, x double, n int").repartition(3), ["g"], "x", ps).collect()}
    assert len(got) == len(own) * len(ps)
    for g, x in own.items():
        for p in ps:
            assert got[g, p][0] == len(x) and got[g, p][1] == pytest.approx(np.quantile(x, p), abs=1e-12)
    assert percentiles.multi_select(spark.createDataFrame([], "g string, x double"), ["g"], "x", ps).count() == 0


def test_selection_goes_in_rounds_and_discards(spark):
    r = np.random.default_rng(6)
    x = {"hot": r.normal(size=20_000), "small": np.array([3.0, 1.0, 2.0]), "inf": np.array([-np.inf, np.inf, 1.0, np.inf])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs], "g string, v double").repartition(4)
    stats = {}
    got = {(t.g, t.p): t.percentile for t in percentiles.multi_select(df, ["g"], "v", [0.1, 0.5], stats).collect()}
    assert stats["rounds"] > 1 and stats["rows"][0] == 20_007 and stats["rows"][1] < 8_000
    for g, p in (("hot", 0.1), ("hot", 0.5), ("small", 0.1), ("small", 0.5)):
        assert got[g, p] == pytest.approx(np.quantile(x[g], p), abs=1e-12)
    assert got["inf", 0.5] == np.inf


def test_summaries_of_loads_combine_within_the_bound(spark):
    r = np.random.default_rng(1)
    rows = [(f"day{d}", "g", float(v)) for d in range(4) for v in r.normal(d, 1 + d, 800)]
    out = percentiles.combine(percentiles.summarize(spark.createDataFrame(rows, "load string, k string, x double"), "load", ["k"], "x"), ["k"], [0.1, 0.5, 0.9]).collect()
    every = np.sort([x[2] for x in rows])
    for x in out:
        assert x.n == 3200 and abs(np.searchsorted(every, x.percentile) - x.p * 3200) <= 3200 / 64 + 4


# splits


def test_components_against_a_model(spark):
    r = random.Random(3)
    for n, m in ((60, 40), (200, 150)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 60)] + [(5, 5)]
        label = {x: x for e in edges for x in e}
        for _ in range(len(label)):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = {x.node: x.component for x in splits.components(spark.createDataFrame([*edges, (1, None), (None, None)], "a bigint, b bigint")).collect()}
        assert got == label
    assert splits.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_closest_subset_is_optimal():
    r = random.Random(4)
    for _ in range(200):
        sizes = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 5))}
        units = [s for s, n in sizes.items() for _ in range(n)]
        target = r.randint(0, sum(units))
        got = splits.closest_subset(sizes, target)
        assert all(0 <= n <= sizes[s] for s, n in got.items())
        best = min(abs(sum(c) - target) for k in range(len(units) + 1) for c in itertools.combinations(units, k)) if len(units) <= 12 else None
        if best is not None:
            assert abs(sum(s * n for s, n in got.items()) - target) == best


def test_subsets_beyond_the_resolution_are_settled_exactly():
    r = random.Random(8)
    for _ in range(60):
        sizes = {r.randint(1, 40): r.randint(1, 30) for _ in range(4)} | {r.randint(500, 9000): r.randint(1, 6) for _ in range(6)}
        total = sum(s * n for s, n in sizes.items())
        target = round(total * r.uniform(0.2, 0.9))
        got, best = splits.closest_subset(sizes, target, 1 << 9), splits.closest_subset(sizes, target)
        assert all(0 <= n <= sizes[s] for s, n in got.items())
        off = [abs(sum(s * n for s, n in x.items()) - target) for x in (got, best)]
        assert off[0] <= max(off[1] + 40, 9000)
    sizes = {1: 400, 7000: 5, 3001: 7}
    assert sum(s * n for s, n in splits.closest_subset(sizes, 31_234, 1 << 12).items()) == 31_234


def test_splits_keep_ties_together(spark):
    rows = [(i, f"b{i % 13}" if i % 10 else None, f"d{i % 26}" if i % 7 else None) for i in range(1300)]
    cells = spark.createDataFrame(rows, "cell bigint, batch string, donor string")
    comp = splits.tied_groups(cells, "batch", "donor")
    assert comp.count() == 13 and splits.tied_groups(cells.limit(0), "batch", "donor").count() == 0
    m = spark.createDataFrame([(i, f"u{min(i % 60, 20)}") for i in range(1000)], "cell bigint, unit string")
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    out = splits.assign_splits(m, t).toPandas()
    assert len(out) == 1000 and out.groupby("unit").split_name.nunique().max() == 1
    n = out.split_name.value_counts()
    assert abs(n["test"] - 100) <= 10 and abs(n["validation"] - 100) <= 10
    assert splits.assign_splits(m.limit(0), t).count() == 0


# term frequency


@pytest.mark.parametrize("max_n", [1, 3])
def test_ngrams_against_a_model(spark, max_n):
    r = random.Random(5)
    docs = {d: ["a" if r.random() < 0.4 else r.choice("bcd") for _ in range(r.randint(1, 30))] for d in range(40)}
    rows = [(d, i, t, 0) for d, ts in docs.items() for i, t in enumerate(ts)] + [(1, 99, None, 0)]
    tf, df = Counter(), Counter()
    for ts in docs.values():
        grams = [tuple(ts[i : i + n]) for n in range(1, max_n + 1) for i in range(len(ts) - n + 1)]
        tf.update(grams)
        df.update(set(grams))
    got = frequency.ngram_frequencies(spark.createDataFrame(rows, "d bigint, i int, t string, n int").repartition(3), "d", "t", ["i"], max_n).collect()
    assert {tuple(x.gram): (x.n_occurrences, x.n_records) for x in got} == {g: (tf[g], df[g]) for g in tf}


def test_terms_of_empty_tables_and_marks(spark):
    e = spark.createDataFrame([], "d bigint, t string")
    assert frequency.ngram_frequencies(e, "d", "t").count() == 0
    c = spark.createDataFrame([("a", 0), ("b", 60), ("c", 10), ("d", None)], "t string, n_records bigint")
    assert {x.t: x.mark for x in frequency.mark(c, 100, 0.05).collect()} == {"a": "rare", "b": "common", "c": "useful", "d": "rare"}
