import numpy as np
import pytest

from sparsequery.cli import has_limit
from sparsequery.dataset import Dataset
from sparsequery.operators import preprocess
from sparsequery.sources import ingest, layout, readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sql_is_bound_to_its_own_tables(ds, spark, small):
    other = Dataset(spark, {**small, "cells": small["cells"].limit(2)}, (2, 3))
    a, b = ds.sql("select count(*) n from cells"), other.sql("with x as (select * from cells) select count(*) n from x")
    assert (a.first().n, b.first().n) == (5, 2)
    assert not spark.catalog.tableExists("cells")


def test_filters(ds):
    assert ds.filter_cells(total_counts=">=7").count() == 4
    assert ds.filter_cells(cell_type=["T"], total_counts="<11").count() == 1
    assert ds.filter_cells().count() == 5 and ds.filter_genes(gene_id="gene_1").count() == 1
    for bad in ({"nope": 1}, {"cell_type": ">5"}, {"total_counts": ">x"}):
        with pytest.raises(ValueError):
            ds.filter_cells(**bad)


def test_point_access(ds):
    assert rows(ds.cell_expression(["cell_0"])) == [("cell_0", "gene_0", 1.0), ("cell_0", "gene_1", 2.0)]
    assert rows(ds.gene_expression(2)) == [("cell_2", "gene_2", 4.0)]
    with pytest.raises(ValueError):
        ds.cell_expression("cell_77")
    assert [(r.start, r.stop) for r in ds.row_ranges().orderBy("cell_integer_id").collect()] == [(0, 2), (2, 3), (3, 4), (4, 4), (4, 4)]


def test_gene_chunks_in_one_scan(ds):
    for chunk in (1, 2, 3, 25_000):
        want = [(r.start // chunk, *row) for r, d in ds.gene_chunks([0, 1], chunk) for row in d.collect()]
        rows = ds.gene_chunk_rows([0, 1], chunk)
        assert sorted(map(tuple, rows.collect())) == sorted(want) and len(want) == 3
        assert rows._jdf.queryExecution().analyzed().toString().count("Union") == 0
    with pytest.warns(UserWarning, match="nope"):
        assert ds.gene_chunk_rows(["gene_2", "nope"], 2).collect() == [(1, "cell_2", "gene_2", 4.0)]


def test_dispersion_on_its_bound(spark):
    from itertools import permutations

    orders = sorted(set(permutations([1.0, 1.0, 1.0, 2.0, 3.0])))  # mean 1.6, variance 0.8, whatever the order
    more = [(1.0, 3.0, 0.5), (1e10, 3e10), (1e200, 1e200)]
    e = spark.createDataFrame([(c, g, v) for g, values in enumerate(orders + more) for c, v in enumerate(values)], "cell_integer_id bigint, gene_integer_id int, value double")
    h = preprocess.highly_variable_genes(e, e.select("gene_integer_id").distinct()).orderBy("gene_integer_id").collect()
    assert all(r.highly_variable and r.dispersions == 0.5 for r in h[: len(orders)])
    assert [round(r.variances, 6) for r in h[len(orders) :][:2]] == [1.75, 2e20]


def test_quality_and_variability(ds, small):
    e, g = small["expression"], small["genes"]
    assert [(r.n_genes_by_counts, r.total_counts) for r in preprocess.cell_qc(e).orderBy("cell_integer_id").collect()] == [(2, 3), (1, 3), (1, 4)]
    assert [(r.n_cells_by_counts, r.total_counts) for r in preprocess.gene_qc(e, g).orderBy("gene_integer_id").collect()] == [(1, 1), (2, 5), (1, 4)]
    h = preprocess.highly_variable_genes(e, g).orderBy("gene_integer_id").collect()
    assert [round(r.dispersions, 6) for r in h] == [0, 0.2, 0] and not any(r.highly_variable for r in h)
    assert [r.gene_integer_id for r in preprocess.highly_variable_genes(e, g, n_top=1).filter("highly_variable").collect()] == [1]
    assert {r.cell_integer_id for r in preprocess.filter_cells(e, min_counts=4).collect()} == {2}
    with pytest.raises(ValueError):
        preprocess.filter_cells(e, max_genes=0)
    v = ds.view().filter_cells(min_genes=1).filter_genes(min_cells=2)
    assert v.shape == (3, 1) and v.X.toarray().ravel().tolist() == [2, 3, 0]


def test_chained_views(ds):
    v = ds[1:4][[1, 0], 1:]
    assert np.array_equal(v.compute()["X"], [[0, 4], [3, 0]]) and [r.cell_id for r in v.obs.collect()] == ["cell_1", "cell_2"]


def test_round_trip_append_and_mutations(spark, small, tmp_path):
    folder = str(tmp_path / "data")
    c = ingest.write_dataset({**small, "layers": spark.createDataFrame([(0, 0, 1.5), (2, 2, None)], "cell_integer_id bigint, gene_integer_id int, spliced double")}, folder)
    assert c.shape == (5, 3) and c.stats["expression_count"] == 4 and round(c.stats["sparsity"], 6) == round(1 - 4 / 15, 6)
    d = Dataset.open(spark, folder)
    assert rows(d.expression.select("cell_integer_id", "gene_integer_id")) == rows(small["expression"].select("cell_integer_id", "gene_integer_id"))
    assert d.expression.schema["value"].dataType.simpleString() == "int"
    assert rows(d.gene_expression("gene_1")) == [("cell_0", "gene_1", 2), ("cell_1", "gene_1", 3)]
    with pytest.raises(FileExistsError):
        ingest.write_dataset(small, folder)
    with pytest.raises(FileNotFoundError):
        Dataset.open(spark, str(tmp_path / "none"))
    # columns
    d.add_obs("score", spark.createDataFrame([(1, 0.5)], "cell_integer_id bigint, score double"))
    again = Dataset.open(spark, folder)
    assert [r.score for r in again.cells.orderBy("cell_integer_id").collect()] == [None, 0.5, None, None, None]
    again.drop_obs("score")
    with pytest.raises(KeyError):
        again.drop_obs("score")
    with pytest.raises(ValueError):
        again.drop_obs("cell_id")
    # layers, pairs, unstructured
    again.add_layer("more", spark.createDataFrame([(0, 0, 9.0), (4, 1, 2.0)], "cell_integer_id bigint, gene_integer_id int, value double"))
    assert again.matrix("more").sum(1).ravel().tolist() == [9, 0, 0, 0, 2] and again.tables["layers"].count() == 3
    with pytest.raises(ValueError):
        again.drop_layer("spliced")
    again.add_pairs("near", spark.createDataFrame([(0, 1, 0.5), (2, 0, 0.2), (0, 2, 0.2)], "id_i bigint, id_j bigint, value double"))
    again.add_pairs("far", spark.createDataFrame([(0, 1, 1.0), (3, 3, 2.0)], "id_i bigint, id_j bigint, value double"))
    assert again.tables["cellsxcells"].count() == 4
    assert again.pairs_dense("near", key=[0, 2]).tolist() == [[0, 0.2], [0.2, 0]]
    again.set_uns("a", {"b": np.arange(2)})
    assert Dataset.open(spark, folder).uns == {"a": {"b": [0, 1]}}
    # append
    readers.write_mtx({**small, "cells": small["cells"].select("cell_integer_id", "cell_id")}, str(tmp_path / "mtx"))
    with pytest.raises(ValueError):
        ingest.append(spark, str(tmp_path / "mtx"), folder)


def test_matrix_market_and_several_inputs(spark, small, tmp_path):
    plain = {**small, "cells": small["cells"].select("cell_integer_id", "cell_id")}
    for n in "ab":
        readers.write_mtx(plain, str(tmp_path / "in" / n))
    t = readers.read_mtx(spark, str(tmp_path / "in" / "a"))
    assert rows(t["expression"]) == rows(small["expression"]) and t["cells"].count() == 5 and t["genes"].count() == 3
    paths, fmt = readers.discover(str(tmp_path / "in"))
    assert fmt == "mtx" and len(paths) == 2
    c = ingest.convert(spark, str(tmp_path / "in"), str(tmp_path / "both"))
    assert c.shape == (10, 3)
    c = ingest.append(spark, str(tmp_path / "in" / "a"), str(tmp_path / "both"))
    d = Dataset.open(spark, str(tmp_path / "both"))
    assert c.shape == (15, 3) and d.cells.filter("source_file = 'a'").count() == 10 and c.stats["expression_count"] == 12
    assert [r.cell_start_index for r in d.cells.orderBy("cell_integer_id").collect()] == [0, 2, 3, 4, 4, 4, 6, 7, 8, 8, 8, 10, 11, 12, 12]
    other = {**plain, "genes": small["genes"].filter("gene_integer_id < 2")}
    with pytest.raises(ValueError):
        ingest.validate([plain, other])
    with pytest.raises(ValueError):
        readers.detect_format(str(tmp_path / "nothing"))


def test_layers_keep_pairs_of_either(spark, small):
    w = ingest.layers_wide(small["expression"], {"s": spark.createDataFrame([(4, 2, 7.0), (0, 0, 1.5)], "cell_integer_id bigint, gene_integer_id int, value double")})
    assert rows(w) == sorted([(0, 0, 1.5), (0, 1, None), (1, 1, None), (2, 2, None), (4, 2, 7.0)], key=str)
    empty = ingest.layers_wide(small["expression"].limit(0), {"s": small["expression"].limit(0)})
    assert layout.expression_stats(small["expression"].limit(0)).first()["count"] == 0 and empty.count() == 0


def test_limits_are_found_outside_strings():
    assert has_limit("select 1 LIMIT 5") and not has_limit("select 'limit 5' from (select 1 limit 5) t -- limit 3")


def test_synthetic(spark):
    t = readers.synthetic(spark, 50, 20, 0.2)
    assert t["cells"].count() == 50 and t["expression"].filter("value < 1").count() == 0 and t["expression"].dropDuplicates(["cell_integer_id", "gene_integer_id"]).count() == t["expression"].count()
    assert readers.parse_hub_path("hf://datasets/u/r/x/y") == ("u/r", "x/y")


def test_append_leaves_what_is_stored(spark, small, tmp_path):
    import os

    folder = str(tmp_path / "data")
    plain = {**small, "cells": small["cells"].select("cell_integer_id", "cell_id")}
    ingest.write_dataset(plain, folder)
    before = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "data").rglob("*.parquet"))}
    # half values don't fit the stored integers; genes in another order
    half = plain["expression"].withColumn("value", plain["expression"]["value"] / 2).withColumn("gene_integer_id", 2 - plain["expression"]["gene_integer_id"])
    turned = plain["genes"].withColumn("gene_integer_id", 2 - plain["genes"]["gene_integer_id"])
    c = ingest.append_tables(spark, {**plain, "genes": turned, "expression": half}, "more", folder)
    assert {p: os.stat(p).st_mtime_ns for p in before} == before and c.shape == (10, 3) and len(c.tables["expression"]) == 2
    d = Dataset.open(spark, folder)
    want = [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0), (2, 2, 4.0)]
    assert rows(d.expression) == sorted(want + [(a + 5, b, v / 2) for a, b, v in want], key=str)
    assert [r.cell_start_index for r in d.cells.orderBy("cell_integer_id").collect()] == [0, 2, 3, 4, 4, 4, 6, 7, 8, 8]
    assert [r.source_file for r in d.cells.orderBy("cell_integer_id").collect()] == ["original_data"] * 5 + ["more"] * 5
    got, own = c.stats["expression_stats"], [v for *_, v in want] + [v / 2 for *_, v in want]
    assert (got["min"], got["max"]) == (0.5, 4) and got["mean"] == pytest.approx(np.mean(own)) and got["std"] == pytest.approx(np.std(own, ddof=1))
    c = ingest.compact(spark, folder)
    d = Dataset.open(spark, folder)
    assert all(len(p) == 1 for p in c.tables.values()) and d.expression.count() == 8 and d.gene_expression("gene_1").count() == 4
    assert not any(os.path.exists(p) for p in before if "genes" not in p)
    assert ingest.append_tables(spark, plain, "third", folder).shape == (15, 3)


def test_resume_and_skipped_inputs(spark, small, tmp_path, monkeypatch):
    plain = {**small, "cells": small["cells"].select("cell_integer_id", "cell_id")}
    for n in "abc":
        readers.write_mtx(plain, str(tmp_path / "in" / n))
    paths, seen, real = [str(tmp_path / "in" / n) for n in "abc"], [], ingest.read_any

    def breaking(s, p, fmt):
        seen.append(p)
        if p.endswith("b") and len(seen) == 2:
            raise OSError("gone")
        return real(s, p, fmt)

    monkeypatch.setattr(ingest, "read_any", breaking)
    with pytest.raises(OSError):
        ingest.convert(spark, paths, str(tmp_path / "out"), resume=True)
    assert layout.load_config(spark, str(tmp_path / "out")).inputs == paths[:1]
    c = ingest.convert(spark, paths, str(tmp_path / "out"), resume=True)
    assert c.shape == (15, 3) and c.inputs == paths and seen == [paths[0], paths[1], paths[1], paths[2]]
    skipped = []
    c = ingest.convert(spark, [paths[0], str(tmp_path / "none")], str(tmp_path / "some"), on_error="skip", skipped=skipped)
    assert c.shape == (5, 3) and [p for p, _ in skipped] == [str(tmp_path / "none")]
    with pytest.raises(ValueError):
        ingest.convert(spark, paths, str(tmp_path / "x"), on_error="skip")


def test_frames_in_memory(spark, tmp_path):
    import pandas as pd

    m = np.array([[0, 2.5], [0, 0], [1, 0]])
    c = ingest.convert_frames(pd.DataFrame({"cell_id": list("abc")}), pd.DataFrame({"gene_id": ["x", "y"]}), m, str(tmp_path / "d"), spark)
    d = Dataset.open(spark, str(tmp_path / "d"))
    assert c.shape == (3, 2) and d.X.toarray().tolist() == m.tolist()
    nested = spark.createDataFrame([(0, (1, "a"))], "cell_integer_id bigint, `a.b` struct<x:int,y:string>")
    assert ingest.clean_metadata(nested, "cell_integer_id").collect()[0].a_b == '{"x":1,"y":"a"}'
