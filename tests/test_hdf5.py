import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from sparsequery.dataset import Dataset
from sparsequery.sources import hdf5, ingest
from sparsequery.sources.partitioned import ParquetSource, read_parts, read_source

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test

M = np.array([[0, 2.0, 0], [1.5, 0, 0], [0, 0, 0], [3.0, 0, 4.0]])


class Array:
    """A stored array with attributes, as an HDF5 library shows it."""

    def __init__(self, x, **attrs):
        self.x, self.attrs = np.asarray(x), attrs
        self.shape, self.dtype = self.x.shape, self.x.dtype

    def __getitem__(self, key):
        return self.x[key]

    def __len__(self):
        return len(self.x)


class Group:
    def __init__(self, attrs=None, **nodes):
        self.nodes, self.attrs = nodes, attrs or {}

    def keys(self):
        return self.nodes.keys()

    def __contains__(self, path):
        try:
            return self[path] is not None
        except KeyError:
            return False

    def __getitem__(self, path):
        node = self
        for part in path.split("/"):
            node = node.nodes[part]
        return node

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def compressed(m, kind="csr"):
    t = m if kind == "csr" else m.T
    indices = [np.flatnonzero(r) for r in t]
    ptr = np.append(0, np.cumsum([len(i) for i in indices]))
    return Group({"encoding-type": f"{kind}_matrix", "shape": np.array(m.shape)}, indptr=Array(ptr), indices=Array(np.concatenate(indices)), data=Array(np.concatenate([r[i] for r, i in zip(t, indices)])))


def strings(*x):
    return Array(np.array([s.encode() for s in x], dtype=object))


def annotated(x):
    obs = Group({"_index": "names"}, names=strings(*"abcd"), kind=Group(codes=Array([0, 1, -1, 0]), categories=strings("T", "B")), **{"n.x": Array([1.0, np.nan, 3.0, 4.0])}, ok=Group(values=Array([1, 2, 3, 4]), mask=Array([False, False, True, False])))
    var = Group({"_index": "_index"}, _index=strings("x", "y", "z"))
    return Group(X=x, obs=obs, var=var, layers=Group(twice=compressed(2 * M), dense=Array(M)), obsm=Group(pca=Array(np.arange(8).reshape(4, 2))), obsp=Group(near=compressed(np.eye(4))), uns=Group(a=Array(np.array([1, 2])), b=Group(c=Array(np.array(b"t")))))


@pytest.mark.parametrize("x", [compressed(M), compressed(M, "csc"), Array(M)], ids=["rows", "columns", "dense"])
def test_annotated_matrix(spark, tmp_path, x):
    opener = lambda _: annotated(x)
    t = hdf5.read_h5ad(spark, "any", 2, opener)
    ingest.write_dataset(t, str(tmp_path / "d"), values="double", uns=hdf5.read_uns("any", opener))
    d = Dataset.open(spark, str(tmp_path / "d"))
    assert d.shape == (4, 3) and np.array_equal(d.X.toarray(), M)
    assert np.array_equal(d.matrix("twice").toarray(), 2 * M) and np.array_equal(d.matrix("dense").toarray(), M)
    obs = d.obs.collect()
    assert [r.cell_id for r in obs] == list("abcd") and [r.kind for r in obs] == ["T", "B", None, "T"] and [r.n_x for r in obs] == [1, None, 3, 4] and [r.ok for r in obs] == [1, 2, None, 4]
    assert d.vector_array("pca").tolist() == np.arange(8).reshape(4, 2).tolist() and np.array_equal(d.pairs_dense("near"), np.eye(4)) and d.uns == {"a": [1, 2], "b": {"c": "t"}}
    with pytest.warns(UserWarning, match="nope"):
        parts = list(d.gene_chunks(["x", "nope"], 3))
    assert [(list(r), sorted(x.value for x in p.collect())) for r, p in parts] == [([0, 1, 2], [1.5]), ([3], [3.0])]


def test_feature_by_barcode_matrices(spark):
    c = compressed(M)
    sparse = {"indptr": c["indptr"], "indices": c["indices"], "data": c["data"], "barcodes": strings(*"abcd"), "shape": Array([3, 4])}
    new = Group(matrix=Group(**sparse, features=Group(id=strings("x", "y", "z"), name=strings("X", "Y", "Z"), feature_type=strings("g", "g", "g"))))
    old = Group(hg19=Group(**sparse, genes=strings("x", "y", "z"), gene_names=strings("X", "Y", "Z")))
    want = [(i, j, M[i, j]) for i, j in zip(*np.nonzero(M))]
    for f in (new, old, Group(X=Array(M))):
        t = hdf5.read_10x_h5(spark, "any", 3, lambda _, f=f: f)
        assert sorted(map(tuple, t["expression"].collect())) == want and t["cells"].count() == 4 and t["genes"].count() == 3
    assert "gene_symbol" in hdf5.read_10x_h5(spark, "any", 3, lambda _: old)["genes"].columns
    with pytest.raises(ValueError):
        hdf5.read_10x_h5(spark, "any", 3, lambda _: Group())
    with pytest.raises(ValueError):
        hdf5.read_frame(Group(a=Array([1]), b=Array([1, 2])), "k", "n")


def test_partitioned_source(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 7 as double) v", "cast(id as string) s").repartition(3).write.option("parquet.block.row.count.limit", 100).parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    src = ParquetSource(t.inputFiles(), ["id", "v"])
    assert src.partition_count() >= 9 and sum(b.num_rows for i in range(src.partition_count()) for b in src.read(i, 30)) == 1000
    got = read_source(spark, src)
    assert got.columns == ["id", "v"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, t.select("id", "v").collect()))
    assert read_parts(spark, t).rdd.getNumPartitions() == src.partition_count()
