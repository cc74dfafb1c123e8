import duckdb
import pytest

from sparsequery import queries as core

D = "/root/testdata/sf0.01"
NAMES = [f"whole_{o}_axis{a}" for o in ("sum", "mean", "var", "std") for a in (0, 1)] + [f"whole_{o}_all" for o in ("sum", "mean", "var")] + ["whole_max_axis0", "whole_min_axis1", "whole_count_axis0", "whole_multi_agg_axis0"]


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for n in ("cells", "genes", "expression"):
        db.execute(f"CREATE VIEW {n} AS SELECT * FROM '{D}/{n}.parquet'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, tables, name):
    want = tables.execute(core.SQL[name]).fetchall()
    got = [tuple(r) for r in core.QUERIES[name](spark, D).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a == pytest.approx(b, rel=1e-9, abs=2e-6)


def test_whole_dense_rows(spark, tables):
    want = tables.execute(core.SQL["whole_dense_rows"]).fetchall()
    got = [tuple(r) for r in core.QUERIES["whole_dense_rows"](spark, D).collect()]
    assert sorted(got) == sorted(want) and all(r.count(",") == 999 for _, r in got)
