import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparsequery.functions import tokens as tk
from sparsequery.operators import batches, shuffle, windows
from sparsequery.operators.rank import global_rank
from sparsequery.operators.windows import GroupSpec

# rows of three groups with falling values, no ties
DATA = [(group, 7 * place + group, value) for group, values in enumerate(([8, 2], [9, 6, 3, 1], [1.5])) for place, value in enumerate(values)]


@pytest.fixture(scope="module")
def e(spark):
    return spark.createDataFrame([(c, g, float(v)) for c, g, v in DATA], "cell_integer_id bigint, gene_integer_id int, value double")


def lists(df, *cols):
    return [tuple(list(r[c]) for c in cols) for r in df.orderBy(df.columns[0]).collect()]


def test_windows(e):
    assert lists(windows.item_window(e, 2), "gene_sequence") == [([0, 7],), ([1, 8],), ([2],)]
    own = [[v for g, _, v in DATA if g == k] for k in range(3)]
    bins = [[min(9, int(np.log1p(v) / np.log1p(max(vs)) * 10 + 1e-9)) for v in vs] for vs in own]
    assert lists(windows.binned_window(e, 4, 10), "expr_sequence") == [(b,) for b in bins]
    # of four ranks those from 60 % of 4 on: 3 and 4
    assert lists(windows.item_window(e, 4, min_percentile=60), "gene_sequence") == [([0],), ([1, 8],), ([2],)]
    assert lists(windows.generic_window(e, 1), "gene_sequence", "expr_sequence") == [([0], [8]), ([1], [9]), ([2], [1.5])]
    with pytest.raises(ValueError):
        windows.create_window("nope")


def test_tokenizers_by_name(e):
    t = windows.tokenizer("geneformer", max_items=3, length=6, vocab_size=100, order="rank")(e)
    assert lists(t, "input_ids", "attention_mask")[1] == ([1, 5, 12, 19, 2, 0], [True] * 5 + [False])
    with pytest.raises(ValueError):
        windows.tokenizer("nope")
    with pytest.raises(ValueError):
        windows.register_tokenizer("scgpt", windows.ValueTokenizer)

    class Counting:
        def __init__(self, length=2):
            self.length = length

        def __call__(self, expression):
            n = expression.groupBy("cell_integer_id").agg(F.count("value").alias("n"))
            ids = F.array_repeat(F.col("n"), self.length)
            return n.select("cell_integer_id", ids.alias("input_ids"), tk.attention_mask(ids).alias("attention_mask"))

    windows.register_tokenizer("counting", lambda **o: Counting())
    out = list(batches.BatchLoader(e, batches.BatchPlan("counting", batch_size=3)))
    assert len(out) == 1 and sorted(out[0]["input_ids"][:, 0].tolist()) == [1, 2, 4]
    del windows.TOKENIZERS["counting"]


def test_groups_over_fragments(spark):
    d = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (2, "a", 1), (4, "a", 1), (5, "b", 1), (6, None, 2)], "id bigint, b string, f int")
    assert sorted(map(tuple, windows.islands(d, "id", "b").filter("b = 'a'").collect())) == [("a", 1, 2, 2), ("a", 4, 4, 1)]
    assert [tuple(r) for r in windows.split_groups(d, "id", "f").collect()] == [(2, 2)]
    need = spark.createDataFrame([(1, 1), (2, 3), (9, 1)], "id bigint, expected int")
    assert sorted(map(tuple, windows.completeness(d, need, "id").collect())) == [(1, 1, 1, True), (2, 3, 2, False), (9, 1, 0, False)]


def test_ties_are_kept_unless_strict(spark):
    spec = GroupSpec("g", "i", "v", "items", "vals")
    d = spark.createDataFrame([(0, i, v) for i, v in zip(range(1, 5), [7.0, 7.0, 5.0, 3.0])], "g int, i int, v double")
    assert lists(windows.generic_window(d, 1, spec), "items") == [([1, 2],)]
    assert lists(windows.generic_window(d, 2, spec), "items") == [([1, 2, 3],)]
    assert lists(windows.generic_window(d, 1, spec, strict=True), "items") == [([1],)]
    assert windows.generic_window(d.limit(0), 1, spec).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(1, 5)), min_size=1, max_size=40, unique_by=lambda t: t[:2]), st.integers(1, 4))
def test_top_k_against_a_model(spark, data, k):
    d = spark.createDataFrame([(c, g, float(v)) for c, g, v in data], "cell_integer_id bigint, gene_integer_id int, value double")
    got = {r.cell_integer_id: list(r.gene_sequence) for r in windows.item_window(d, k).collect()}
    for c in {x[0] for x in data}:
        own = [(g, v) for cc, g, v in data if cc == c]
        top = sorted({v for _, v in own}, reverse=True)[:k]
        assert got[c] == sorted(g for g, v in own if v in top)


def test_tokens(spark):
    d = spark.createDataFrame([([0, 1, 2],), ([],)], "g array<int>")
    assert [list(r[0]) for r in d.select(tk.rank_tokens(F.col("g"), 1000, 6)).collect()] == [[1, 4, 5, 6, 2, 0], [1, 2, 0, 0, 0, 0]]
    assert [list(r[0]) for r in d.limit(1).select(tk.rank_tokens(F.col("g"), 1000, 4)).collect()] == [[1, 4, 5, 6]]
    p = spark.createDataFrame([([0, 1], [9, 7], [0.55, 0.85])], "g array<int>, b array<int>, v array<double>")
    i, v = tk.value_tokens(F.col("g"), F.col("b"), 1000, 3)
    assert [list(x) for x in p.select(i, v).first()] == [[1, 4, 5, 2, 0], [0, 1009, 1007, 0, 0]]
    _, v = tk.value_tokens(F.col("g"), F.col("v"), 1000, 3, binned=False)
    assert list(p.select(v).first()[0]) == [0, 1005, 1008, 0, 0]


def test_orders(spark, e):
    g = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    a = shuffle.random_order(g, "k", 1, 32).toPandas().sort_values("place")
    assert sorted(a.k) == list(range(100)) and a.place.tolist() == list(range(100)) and a.batch.value_counts().max() == 32 and a.k.tolist() != sorted(a.k)
    assert a.k.tolist() == shuffle.random_order(g, "k", 1).toPandas().sort_values("place").k.tolist()
    s = shuffle.stratified_order(g, "k", "s", 1).toPandas().sort_values("place")
    assert s.s.tolist()[:9] == [0, 1, 2] * 3 and sorted(s.k) == list(range(100))
    m = shuffle.mixed_scanner_order(g.withColumn("f", F.floor(F.col("k") / 10)), "f", "k", 4, 2).toPandas()
    assert sorted(m.k) == list(range(100)) and sorted(m.place) == list(range(100))
    ep = shuffle.epochs(g, "k", 2).toPandas()
    assert all(sorted(ep[ep.epoch == i].place) == list(range(100)) for i in (0, 1)) and ep[ep.epoch == 0].sort_values("place").k.tolist() != ep[ep.epoch == 1].sort_values("place").k.tolist()
    assert sorted(sum(shuffle.assign_partitions(10, 3), [])) == list(range(10)) and [len(x) for x in shuffle.assign_partitions(10, 3)] == [4, 3, 3]
    assert global_rank(g.limit(0), [F.col("k")]).count() == 0


def test_loader_sends_no_padding(e):
    for kind, columns in (("geneformer", 1), ("scgpt", 2)):
        loader = batches.BatchLoader(e, batches.BatchPlan(kind, batch_size=2))
        sent = [r.asDict() for r in loader.packed().collect()]
        out = list(loader)
        assert [b["input_ids"].shape for b in out] == [b["attention_mask"].shape for b in out] == [(2, 2048 + 2 * (columns - 1)), (1, 2048 + 2 * (columns - 1))]
        live = sum(len(r[c]) for r in sent for c in r if c in ("input_ids", "attention_mask", "values"))
        assert live == 8 * columns * loader.metrics["tokens"] > 0
        own = {r.cell_integer_id: r.asDict() for r in batches.token_table(e, batches.BatchPlan(kind)).collect()}
        for c in ("input_ids", "attention_mask", "values")[: columns + 1]:
            assert {int(i): x.tolist() for b in out for i, x in zip(b["cell_ids"], b[c])} == {i: list(r[c]) for i, r in own.items()}


def test_loader_delivers_every_group_once_per_epoch(e):
    for kind in ("geneformer", "scgpt", "raw"):
        out = list(batches.BatchLoader(e, batches.BatchPlan(kind, batch_size=2, max_items=4, n_epochs=2)))
        assert [len(b["cell_ids"]) for b in out] == [2, 1, 2, 1] and [b["epoch"] for b in out] == [0, 0, 1, 1]
        if kind != "raw":
            own = {r.cell_integer_id: list(r.input_ids) for r in batches.token_table(e, batches.BatchPlan(kind, max_items=4)).collect()}
            assert {int(c): x.tolist() for b in out[2:] for c, x in zip(b["cell_ids"], b["input_ids"])} == own and out[0]["attention_mask"].dtype == bool
        assert sorted(np.concatenate([b["cell_ids"] for b in out[:2]])) == [0, 1, 2]
    assert out[0]["x"][0][0]
    loader = batches.BatchLoader(e, batches.BatchPlan(batch_size=2, max_items=4))
    n = sum(int(b["attention_mask"].sum()) for b in loader)
    assert (loader.metrics["batches"], loader.metrics["rows"], loader.metrics["tokens"]) == (2, 3, n) and list(batches.BatchLoader(e.limit(0))) == []
    with pytest.raises(ValueError):
        batches.BatchPlan("nope")
