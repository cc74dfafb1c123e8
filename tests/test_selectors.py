import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparsequery.plans.selectors import compose, id_batches, is_consecutive, normalize, parse_key, strategy

N = 10
ends = st.one_of(st.none(), st.integers(-13, 13))
slices = st.builds(slice, ends, ends, st.one_of(st.none(), st.integers(-3, 3).filter(bool)))
lists = st.lists(st.integers(-N, N - 1), max_size=8)


@given(slices)
def test_slices_are_those_of_numpy(s):
    assert normalize(s, N).positions().tolist() == np.arange(N)[s].tolist()


@given(slices, st.one_of(slices, st.just([0])))
def test_composition_is_that_of_numpy(a, b):
    x = np.arange(N)[a]
    if isinstance(b, list) and not len(x):
        return
    assert compose(normalize(a, N), b).positions().tolist() == x[b].tolist()


@given(lists)
def test_lists_keep_order_and_repeats(ids):
    assert normalize(ids, N).positions().tolist() == np.arange(N)[np.array(ids, int)].tolist()


def test_masks_and_errors():
    assert normalize(np.arange(N) % 2 == 0, N).positions().tolist() == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        normalize([True, False], N)
    with pytest.raises(IndexError):
        normalize(10, N)
    with pytest.raises(IndexError):
        normalize([0, -11], N)
    with pytest.raises(ValueError):
        normalize(slice(None, None, 0), N)
    with pytest.raises(IndexError):
        parse_key((1, 2, 3))
    assert parse_key((1,)) == (1, None)


def test_id_sets():
    assert is_consecutive([3, 4, 5]) and not is_consecutive([3, 5]) and is_consecutive([])
    assert id_batches([1, 2, 3, 50, 51]) == [[1, 2, 3], [50, 51]]
    assert [len(b) for b in id_batches(list(range(250)))] == [100, 100, 50]
    assert [strategy(x) for x in ([], [1], [1, 2], [1, 9], list(range(0, 4000, 2)))] == ["empty", "single", "consecutive", "in list", "semi-join"]


def test_predicates_and_semi_join(spark):
    df = spark.range(5000).withColumnRenamed("id", "x")
    for key in (slice(3, 40, 7), slice(40, 3, -7), [5, 5, 9], [7, 8, 9], [], list(range(0, 4000, 2)), slice(0, 0)):
        s = normalize(key, 5000)
        assert sorted(r.x for r in s.apply(df, "x").collect()) == sorted(set(s.positions().tolist()))


def test_selection_by_a_table(ds, spark):
    from sparsequery.plans.selectors import TableSelector

    ids = spark.createDataFrame([(2,), (0,), (2,), (None,), (1,)], "i bigint")
    s = TableSelector.of(5, ids)
    assert len(s) == 3 and s.positions().tolist() == [0, 1, 2]
    assert s.part(normalize(slice(1, None), 3)).positions().tolist() == [1, 2]
    assert s.part(normalize([2, 0, 2], 3)).positions().tolist() == [2, 0, 2] and s.part(normalize([2, 0, 2], 3)).repeats()
    assert s.part(normalize(slice(0, 0), 3)).positions().tolist() == []
    assert ds.X[ids].toarray().tolist() == [[1, 2, 0], [0, 3, 0], [0, 0, 4]]
    assert ds.X[ids][[2, 0, 2]].sum(0).tolist() == [[1, 2, 8]] and ds.X[ids].mean(1).ravel().tolist() == [1, 1, 4 / 3]
    v = ds.view().where_cells(cell_type="T").where_genes(gene_id="gene_2")
    assert v.shape == (3, 1) and v.X.toarray().ravel().tolist() == [0, 4, 0]


def test_vector_arrays(ds, spark):
    ds.add_obs("v", spark.createDataFrame([(0, [1.0, 2.0]), (2, [3.0, 4.0])], "cell_integer_id bigint, v array<float>"))
    a = ds.vector_array("v", key=[2, 1, 0])
    assert a[[0, 2]].tolist() == [[3, 4], [1, 2]] and np.isnan(a[1]).all()
