import numpy as np
import pytest

DENSE = np.array([[1, 2, 0], [0, 3, 0], [0, 0, 4], [0, 0, 0], [0, 0, 0]], float)


@pytest.mark.parametrize("key", [(slice(None), slice(None)), (slice(0, 4), [0, 2]), ([4, 0, 0], slice(None, None, -1)), ([1, 2], [1]), (-1, None)])
def test_views_match_numpy(ds, key):
    rows, cols = (k if k is not None else slice(None) for k in key)
    want = DENSE[[rows] if isinstance(rows, int) else rows][:, cols]
    m = ds.X[key]
    assert m.shape == want.shape
    assert np.array_equal(m.toarray(), want)
    for op in ("sum", "mean", "var", "std"):
        for axis in (0, 1):
            assert np.allclose(getattr(m, op)(axis), getattr(want, op)(axis, keepdims=True)), (op, axis)


def test_reductions_of_everything(ds):
    assert ds.X.sum() == 10 and np.isclose(ds.X.mean(), 10 / 15) and np.isclose(ds.X.var(), DENSE.var())
    assert np.isclose(np.mean(ds.X), DENSE.mean()) and np.allclose(np.sum(ds.X, axis=0), DENSE.sum(0, keepdims=True))
    assert ds.X.reduce("max", "min", "count", axis=1).orderBy("cell_integer_id").toPandas().values.tolist() == [[0, 2, 1, 2], [1, 3, 3, 1], [2, 4, 4, 1], [3, 0, 0, 0], [4, 0, 0, 0]]


def test_transforms_use_whole_rows(ds):
    m = ds.X.normalize_total().log1p()[:2, 1:2]
    assert np.allclose(m.toarray(), np.log1p([[20000 / 3], [10000]]))
    assert np.allclose(m.keep_transforms().toarray(), [[2], [3]])
    assert np.allclose(m.keep_transforms(["normalize_total"]).toarray(), [[20000 / 3], [10000]])
    with pytest.raises(ValueError):
        ds.X.normalize_total(0)


def test_compressed_rows_and_dense_rows(ds):
    data, cols, ptr = ds.X.csr()
    assert data.tolist() == [1, 2, 3, 4] and cols.tolist() == [0, 1, 1, 2] and ptr.tolist() == [0, 2, 3, 4, 4, 4]
    assert [r["row"] for r in ds.X[:, ::-1].dense_rows().orderBy("cell_integer_id").collect()] == DENSE[:, ::-1].tolist()


def test_a_table_without_rows(ds, spark):
    from sparsequery.dataset import Dataset

    d = Dataset(spark, {**ds.tables, "expression": ds.expression.limit(0)}, (5, 3))
    assert not d.X.toarray().any() and d.X.mean(1).shape == (5, 1) and d.X.sum() == 0


def test_bad_reductions(ds):
    with pytest.raises(ValueError):
        ds.X.reduce("median", axis=0)
    with pytest.raises(ValueError):
        ds.X.reduce("sum", axis=2)
    with pytest.raises(ValueError):
        ds.X[0:0].mean(0)
