import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsequery.llm import clusters, forest, neighbours

DIM = 8


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    x = []
    for size in (40, 30, 12, 3, 3):
        c = r.normal(size=DIM)
        c /= np.linalg.norm(c)
        x += [c + r.normal(size=DIM) * 0.03 for _ in range(size)]
    x += list(r.normal(size=(60, DIM)))
    x += [x[5]] * 30 + [x[-1]] * 3  # exact copies
    x = np.array(x, np.float32)
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += rows[:5]  # delivered twice
    bad = [(1000, None, 0.0), (1001, [1.0] * (DIM - 1), 0.0), (1002, [0.0] * DIM, 0.0), (1003, [float("nan")] * DIM, 0.0), (1004, [float("inf")] + [0.0] * (DIM - 1), 0.0), (1005, [None] * DIM, 0.0), (None, [1.0] * DIM, 0.0)]
    return x, spark.createDataFrame(rows + bad, "id bigint, v array<float>, cosine double")


def cosines(x):
    u = forest.unit(x)
    return u @ u.T


def test_every_neighbour_of_a_single_leaf(data):
    x, df = data
    s = np.round(cosines(x), 12)
    got = {}
    for r in neighbours.nearest_vectors(df, "id", "v", DIM, k=4).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    assert set(got) == set(range(len(x)))
    for i in range(len(x)):
        near = [j for _, j in sorted(got[i])]
        same = np.isclose(s[i], 1)
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-(1.0 if (x[j] == x[i]).all() else s[i, j]), j))[:4]
        if same.sum() > 1:
            assert near == order
        assert np.allclose(sorted(s[i, near]), sorted(s[i, order]), atol=1e-6)


def test_recall_of_a_forest(spark):
    r = np.random.default_rng(2)
    c = r.normal(size=(30, 16))
    x = (c[r.integers(0, 30, 4000)] + r.normal(size=(4000, 16)) * 0.25).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    got = neighbours.nearest_vectors(df, "id", "v", 16, k=10, trees=3, probes=6, leaf_size=500).toPandas().groupby("id").neighbour.agg(set)
    s = cosines(x)
    np.fill_diagonal(s, -1)
    hits = sum(len(got[i] & set(np.argsort(-s[i])[:10].tolist())) for i in range(4000))
    assert hits / 40_000 >= 0.9


def test_exact_neighbours_and_recall(data):
    x, df = data
    exact = neighbours.exact_neighbours(df, "id", "v", F.col("id") % 7 == 0, DIM, k=4, block=5)
    s = cosines(x)
    got = exact.toPandas().sort_values(["id", "rank"]).groupby("id").neighbour.agg(list)
    assert set(got.index) == {i for i in range(len(x)) if i % 7 == 0}
    for i, near in got.items():
        best = np.sort(np.delete(s[i], i))[::-1][:4]
        assert len(set(near)) == 4 and np.allclose(np.sort(s[i, near])[::-1], best, atol=1e-6)
    r = neighbours.recall(neighbours.nearest_vectors(df, "id", "v", DIM, k=4), exact).first()
    assert r.n_pairs == 4 * len(got) and r.recall > 0.98
    assert neighbours.exact_neighbours(df.limit(0), "id", "v", F.col("id") % 7 == 0, DIM).count() == 0


def test_visits_grow_with_the_leaves(spark):
    r = np.random.default_rng(4)
    c = r.normal(size=(30, 16))
    x = (c[r.integers(0, 30, 6000)] + r.normal(size=(6000, 16)) * 0.5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    got = neighbours.nearest_vectors(df, "id", "v", 16, k=10, leaf_size=150, group=4).toPandas()
    assert not got.duplicated(["id", "neighbour"]).any() and (got.groupby("id").size() == 10).all()
    near, s = got.groupby("id").neighbour.agg(set), cosines(x)
    np.fill_diagonal(s, -1)
    hits = sum(len(near[i] & set(np.argsort(-s[i])[:10].tolist())) for i in range(0, 6000, 10))
    assert hits / 6_000 >= 0.9


def test_thresholded_pairs_and_empty_tables(data):
    x, df = data
    p = neighbours.similar_pairs(neighbours.nearest_vectors(df, "id", "v", DIM, k=200, least=0.9999), 0.9999)
    s = cosines(x)
    assert {tuple(r) for r in p.collect()} == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.9999}
    assert neighbours.nearest_vectors(df.limit(0), "id", "v", DIM).count() == 0


def test_closed_groups(data):
    x, df = data
    least = 0.86
    s = cosines(x) >= least
    want = {}
    for i in range(len(x)):
        own = np.flatnonzero(s[i])
        if len(own) >= 3 and all((s[j] == s[i]).all() for j in own):
            want[i] = int(own.min())
    g = clusters.density_groups(df, "id", "v", DIM, eps=1 - least, reach=1 - least)
    out = clusters.closed_groups(g, DIM, least, block=16).toPandas()
    assert dict(zip(out.id, out.groupby("base").id.transform("min"))) == want and len(want) > 30


def closed_by_brute_force(x, least):
    s, want = cosines(x) >= least, {}
    for i in range(len(x)):
        own = np.flatnonzero(s[i])
        if len(own) >= 3 and all((s[j] == s[i]).all() for j in own):
            want[i] = int(own.min())
    return want


def closed_groups_of(spark, x, least, **kw):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    out = clusters.closed_groups(clusters.density_groups(df, "id", "v", x.shape[1], eps=1 - least, reach=0.5, **kw), x.shape[1], least).toPandas()
    return dict(zip(out.id, out.groupby("base").id.transform("min")))


def test_no_link_between_leaves_is_left_out(spark):
    r = np.random.default_rng(6)
    c = r.normal(size=(300, 32))
    x = np.concatenate([np.repeat(c, 4, axis=0) + r.normal(size=(1200, 32)) * 0.3, r.normal(size=(1200, 32))]).astype(np.float32)
    want = closed_by_brute_force(x, 0.86)
    assert len(want) > 500 and closed_groups_of(spark, x, 0.86, leaf_size=20, block=700) == want


def test_pieces_are_as_far_as_their_members(spark):
    # two groups whose centroids are within the distance, but no two of their members
    t, x = 0.386, np.zeros((6, 8))
    x[:3, 0], x[3:, 0], x[3:, 1] = 1, 0.95, np.sqrt(1 - 0.95**2)
    x[range(6), range(2, 8)] = t
    x = x.astype(np.float32)
    assert closed_by_brute_force(x, 0.86) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert closed_groups_of(spark, x, 0.86) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_comparisons_shuffle_no_vectors(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([np.repeat(r.normal(size=(150, 64)), 4, axis=0) + r.normal(size=(600, 64)) * 0.3, r.normal(size=(900, 64))]).astype(np.float32)
    want = closed_by_brute_force(x, 0.86)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert closed_groups_of(spark, x, 0.86, leaf_size=20, block=16) == want  # so many blocks that a task has several pairs of them
    moved = written() - before
    assert len(want) > 300 and x.nbytes < moved < 9 * x.nbytes


def test_members_by_position(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(9).normal(size=(60, 4)).astype(np.float32)
    file = str(tmp_path / "members.parquet")
    pq.write_table(pa.table({"own": [v.tobytes() for v in x]}), file, row_group_size=7)
    read = clusters.member_reader(4, keep=2)
    first, size = np.array([0, 20, 23, 24]), np.array([20, 3, 1, 36])
    for f, n in zip(first, size):
        assert (read(file, f, n) == x[f : f + n]).all()
    u, v = np.triu_indices(4, 1)
    d = 1 - cosines(x)
    nearest = [d[first[i] : first[i] + size[i], first[j] : first[j] + size[j]].min() for i, j in zip(u, v)]
    eps = np.sort(nearest)[3] + 1e-9
    which, got = clusters.member_links(np.stack([u, v]), (np.array([file] * 4, object), first, size), read, eps, block=5)
    assert dict(zip(which.tolist(), got.round(12).tolist())) == {e: round(near, 12) for e, near in enumerate(nearest) if near <= eps}


def test_asks_and_links_of_blocks():
    r = np.random.default_rng(7)
    x = forest.unit(r.normal(size=(90, 4)))
    radius = np.where(np.arange(90) % 3 == 0, 0.2, 0.0)
    d, theta, every = 1 - x @ x.T, np.arccos(0.86), np.arange(90)
    for left, right in ((every, every), (every[:50], every[50:])):
        i, j, w, ask = clusters.block_links(x, radius, left, every if left is every else right, 2, 0.5, 0.14, limit=50)
        pairs = {(a, b) for a in left for b in right if a < b}
        both = radius[:, None] + radius
        assert {tuple(sorted(p)) for p in ask.T.tolist()} == {(a, b) for a, b in pairs if both[a, b] and d[a, b] <= 1 - np.cos(theta + both[a, b])}
        full = np.where(both > 0, np.maximum(d, 0.14 + 1e-9), d)
        for cut in (0.14, 0.3, 0.5):  # the same components at every height
            names = []
            for edges in ([(a, b) for a, b in pairs if full[a, b] <= cut], zip(i[w <= cut].tolist(), j[w <= cut].tolist())):
                parent = list(range(90))
                for a, b in edges:
                    parent[clusters._find(parent, a)] = clusters._find(parent, b)
                roots = [clusters._find(parent, a) for a in range(90)]
                names.append([roots.index(z) for z in roots])
            assert names[0] == names[1]


def test_comparison_in_tiles():
    import tracemalloc

    r = np.random.default_rng(10)
    x, y = (forest.unit(r.normal(size=(n, 8))).astype(np.float32) for n in (45, 70))
    floor = np.where(np.arange(45) % 2 == 0, 0.5, 0.3).astype(np.float32)
    for tall, wide in ((512, 256), (16, 32), (45, 70)):
        got = clusters.pairs_above(x, y, floor, tall, wide)
        assert [a.tolist() for a in got] == [a.tolist() for a in np.nonzero(x @ y.T >= floor[:, None])]
    assert all(len(a) == 0 for a in clusters.pairs_above(x, y[:0], floor))
    # products of whole rows would not fit a cache: 128 MB here
    x = forest.unit(r.normal(size=(50_000, 32)))
    tracemalloc.start()
    clusters.block_links(x, np.zeros(50_000), np.arange(600), np.arange(600, 50_000), 2, 0.2, 0.14)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_hierarchy(data):
    _, df = data
    lab = clusters.density_groups(df, "id", "v", DIM, eps=0.05, reach=0.4)["labels"].toPandas()
    assert lab.id.is_unique and (lab.groupby("base").cluster.nunique(dropna=False) == 1).all()
    assert lab.cluster.value_counts().max() >= 40
    empty = clusters.density_groups(df.limit(0), "id", "v", DIM, eps=0.05, reach=0.4)
    assert empty["labels"].count() == 0 and clusters.closed_groups(empty, DIM, 0.9).count() == 0


def test_tree_is_minimal(spark):
    r = np.random.default_rng(3)
    edges = {(int(min(a, b)), int(max(a, b))): float(w) for a, b, w in zip(r.integers(0, 60, 300), r.integers(0, 60, 300), r.integers(1, 20, 300)) if a != b}
    tree, labels = clusters.boruvka(spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u bigint, v bigint, w double"))
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = 0.0
    for (u, v), w in sorted(edges.items(), key=lambda e: e[1]):
        if find(u) != find(v):
            parent[find(u)] = find(v)
            total += w
    rows = tree.collect()
    assert sum(x.w for x in rows) == total and len({x.c for x in labels.collect()}) == labels.count() - len(rows)


def test_stability_prefers_lasting_clusters():
    nodes = [(1, 10, 10 / 0.05), (2, 10, 10 / 0.05), (3, 1, 2.0)]
    assert clusters.condense(nodes, [(0.3, 1, 2), (0.4, 2, 3)], 3, 0.5) == {1: 1, 2: 2}
    assert clusters.condense([(1, 10, 10 / 0.1), (2, 10, 10 / 0.1)], [(0.11, 1, 2)], 3, 0.5) == {1: 1, 2: 1}
    assert clusters.condense([(1, 1, 1.0)], [], 3, 0.5) == {}
