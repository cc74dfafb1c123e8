"""Forest of random-projection trees over vectors, and the exact work inside its leaves.

The trees are built on the driver from a bounded sample (``max_sample`` vectors); every vector is then indexed. A
vector descends all trees at once through one shared priority queue of (largest boundary crossed so far): it always
visits its own leaf in each tree, and the remaining visits go to the leaves behind the nearest boundaries of any tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers

BLOCK = 1024  # rows of a similarity block
TILE = 1 << 25  # numbers of a similarity block


def block_rows(n: int) -> int:
    """Rows of a block of similarities with ``n`` others."""
    return max(16, min(BLOCK, TILE // max(n, 1)))


def first_of_each(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of every distinct row, number of its distinct row for each row)."""
    _, first, back = np.unique(np.ascontiguousarray(raw).view(f"V{raw.itemsize * raw.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, back


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str, dim: int, keep_unusable: bool = False) -> DataFrame:
    """(id, ``vec`` binary of ``dim`` float32) of rows whose vector is usable: right length, finite, not all zero.

    Null ids and null vectors are left out.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            ids, lists = b.column(0), b.column(1)
            ok = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False).to_numpy(zero_copy_only=False)
            lists, ids = lists.filter(pa.array(ok)), ids.filter(pa.array(ok))
            x = pc.fill_null(lists.flatten().cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x = np.ascontiguousarray(x[good]) + np.float32(0)  # -0.0 becomes 0.0
            n = len(x)
            at = pa.py_buffer(np.arange(0, (n + 1) * dim * 4, dim * 4, dtype=np.int32))
            vec = pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), vec], names=["id", "vec"])

    workers(rows.sparkSession)
    src = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("key")).filter("id is not null and key is not null")
    return src.mapInArrow(run, "id bigint, vec binary")


def as_matrix(vec, dim: int) -> np.ndarray:
    """Float32 rows of an Arrow binary column whose values all have ``dim`` numbers."""
    import pyarrow as pa

    if isinstance(vec, pa.ChunkedArray):
        vec = vec.combine_chunks() if vec.num_chunks != 1 else vec.chunk(0)
    if not len(vec):
        return np.zeros((0, dim), np.float32)
    if not pa.types.is_binary(vec.type):
        vec = vec.cast(pa.binary())
    _, off, data = vec.buffers()
    first = int(np.frombuffer(off, np.int32)[vec.offset])
    return np.frombuffer(data, np.float32, len(vec) * dim, first).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; done in double precision so that very small and large rows keep their direction."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


class Forest:
    """Trees as flat arrays: node -> normal, offset, children; leaves have no children and a number of their own."""

    def __init__(self, sample: np.ndarray, n_rows: int, trees: int, leaf_size: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.trees, self.roots = trees, []
        self.normal, self.offset, self.child = [], [], []
        # a leaf is closed when the sample says that it holds no more than leaf_size rows, or at 16 sample rows
        least = max(16, leaf_size * len(sample) / max(n_rows, 1))
        for _ in range(trees):
            self.roots.append(self._grow(sample, rng, least))
        dim = sample.shape[1]
        self.normal = np.array(self.normal, np.float32).reshape(-1, dim)
        self.offset = np.array(self.offset, np.float32)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def _new(self, dim: int) -> int:
        self.normal.append(np.zeros(dim, np.float32))
        self.offset.append(0.0)
        self.child.append((-1, -1))
        return len(self.offset) - 1

    def _grow(self, sample: np.ndarray, rng, least: float) -> int:
        root = self._new(sample.shape[1])
        work = [(root, sample)]
        while work:
            node, x = work.pop()
            if len(x) <= least:
                continue
            cut = self._cut(x, rng)
            if cut is None:
                continue
            normal, offset, right = cut
            a, b = self._new(x.shape[1]), self._new(x.shape[1])
            self.normal[node], self.offset[node], self.child[node] = normal, offset, (a, b)
            work += [(a, x[~right]), (b, x[right])]
        return root

    @staticmethod
    def _cut(x: np.ndarray, rng):
        """A hyperplane across the line between two random rows, at the widest gap of the middle projections."""
        best = None
        for _ in range(4):
            i, j = rng.choice(len(x), 2, replace=False)
            d = x[i] - x[j]
            size = np.linalg.norm(d)
            if size < 1e-6:
                continue
            d = (d / size).astype(np.float32)
            p = np.sort(x @ d)
            lo, hi = int(0.3 * len(p)), max(int(0.7 * len(p)), int(0.3 * len(p)) + 1)
            gaps = p[lo + 1 : hi + 1] - p[lo:hi]
            k = int(gaps.argmax())
            at = (p[lo + k] + p[lo + k + 1]) / 2
            if gaps[k] > 0 and (best is None or gaps[k] > best[0]):
                best = gaps[k], d, np.float32(at)
        if best is None:
            return None
        right = x @ best[1] > best[2]
        return None if right.all() or not right.any() else (best[1], best[2], right)

    def visits(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, own) of shape (rows, probes): the ``probes`` leaves of least crossing over all trees.

        The shared queue is worked off level by level: of all open nodes of all trees the ``probes`` cheapest stay.
        A node is as cheap as the cheapest leaf below it, so this keeps exactly the leaves a best-first search pops.
        """
        n, probes = len(x), max(probes, self.trees)
        node = np.full((n, probes), -1, np.int64)
        cost = np.full((n, probes), np.inf, np.float32)
        own = np.zeros((n, probes), bool)
        node[:, : self.trees], cost[:, : self.trees], own[:, : self.trees] = self.roots, -1.0, True
        rows = np.arange(n)[:, None]
        while True:
            open_ = (node >= 0) & (self.child[node, 0] >= 0)
            if not open_.any():
                return node, own
            m = np.einsum("nd,npd->np", x, self.normal[node]) - self.offset[node]
            side = (m > 0).astype(np.int64)
            near = np.where(open_, self.child[node, side], node)
            far = np.where(open_, self.child[node, 1 - side], -1)
            far_cost = np.where(open_, np.maximum(cost, np.abs(m)), np.inf).astype(np.float32)
            all_cost = np.concatenate([cost, far_cost], 1)
            pick = np.argpartition(all_cost, probes - 1, axis=1)[:, :probes]
            cost = all_cost[rows, pick]
            node = np.where(np.isinf(cost), -1, np.concatenate([near, far], 1)[rows, pick])
            own = np.concatenate([own, np.zeros_like(own)], 1)[rows, pick]

    def leaves(self) -> float:
        """Mean number of leaves of a tree."""
        return float((self.child[:, 0] < 0).sum()) / self.trees

    def groups(self, size: int) -> np.ndarray:
        """For every leaf the root of the largest subtree with at most ``size`` leaves that holds it."""
        below = np.ones(len(self.child), np.int64)
        for i in range(len(self.child) - 1, -1, -1):  # children have higher numbers than their parent
            if self.child[i, 0] >= 0:
                below[i] = below[self.child[i]].sum()
        out = np.arange(len(self.child))
        for i, (a, b) in enumerate(self.child):
            if a >= 0:
                out[[a, b]] = out[i] if below[out[i]] <= size else (a, b)
        return out


def members(vectors: DataFrame) -> DataFrame:
    """(id, ``h1``, ``h2``): distinct ids with a 128-bit name of their vector, without the vector itself."""
    return vectors.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2")).distinct()


def build(vectors: DataFrame, dim: int, trees: int, leaf_size: int, max_sample: int = 131_072, seed: int = 0) -> Forest:
    """A forest fitted on at most about ``max_sample`` vectors, chosen by a hash of their id."""
    n = vectors.count()
    share = min(1.0, max_sample / max(n, 1), max(64 * n / leaf_size, 20_000) / max(n, 1))
    chosen = vectors.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    t = chosen.select("id", "vec").toArrow().sort_by("id")
    x = as_matrix(t.column("vec"), dim)
    return Forest(unit(x).astype(np.float32) if len(x) else np.zeros((0, dim), np.float32), n, trees, leaf_size, seed)


def place(vectors: DataFrame, forest: Forest, dim: int, probes: int, group: int = 0) -> DataFrame:
    """(leaf, own, id, vec): a row per visit of each distinct vector of an input partition.

    With ``group``, (leaves, visits, own, id, vec): a row per subtree of up to ``group`` leaves that is visited, with the
    leaves visited there and whether each is an own one, so that many visits don't send a vector as many times.

    Equal vectors visit the same leaves, so copies merge without a shuffle of their own: inside a chunk of rows here, and
    for good in the leaf (:func:`merge_copies`). A vector that a third of all rows hold sends a row per chunk and visit.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(forest)  # at most max_sample / 16 leaves a tree
    roots = forest.groups(group) if group else None

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        f = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                raw, ids = as_matrix(c.column(1), dim), c.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")  # of equal vectors the smallest id goes
                kept = np.sort(order[first_of_each(raw[order])[0]])
                raw, kept = raw[kept], pa.array(kept)
                if not len(raw):
                    continue
                leaf, own = f.visits(unit(raw).astype(np.float32), probes)
                r, p = np.nonzero(leaf >= 0)
                if group:
                    order = np.lexsort((roots[leaf[r, p]], r))
                    r, p = r[order], p[order]
                    root = roots[leaf[r, p]]
                    starts = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (root[1:] != root[:-1])))
                    ends = pa.array(np.append(starts, len(r)), pa.int32())
                    t = kept.take(pa.array(r[starts]))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(v[r, p])) for v in (leaf, own)]
                    yield pa.RecordBatch.from_arrays([pa.array(root[starts]), *lists, c.column(0).take(t), c.column(1).take(t)], names=["leaves", "visits", "own", "id", "vec"])
                    continue
                t = kept.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[r, p]), pa.array(own[r, p]), c.column(0).take(t), c.column(1).take(t)], names=["leaf", "own", "id", "vec"])

    kind = "leaves bigint, visits array<bigint>, own array<boolean>" if group else "leaf bigint, own boolean"
    return vectors.select("id", "vec").mapInArrow(run, f"{kind}, id bigint, vec binary")


def merge_copies(t, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest ids, vectors, own) of the distinct vectors of a leaf."""
    ids, own, raw = t.column("id").to_numpy(), t.column("own").to_numpy(zero_copy_only=False), as_matrix(t.column("vec"), dim)
    if not len(ids):
        return ids, raw, own
    first, back = first_of_each(raw)
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, back, ids)
    order = np.argsort(low)
    return low[order], raw[first[order]], own[first[order]]


def group_neighbours(t, dim: int, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`leaf_neighbours` over the leaves of a subtree: for every visitor its ``k`` best of all of them.

    ``t``: rows of :func:`place` with ``group``. Copies from several partitions merge; equal vectors have equal visits.
    """
    ids, raw = t.column("id").to_numpy(), as_matrix(t.column("vec"), dim)
    order = np.argsort(ids, kind="stable")
    first = order[np.sort(first_of_each(raw[order])[0])] if len(ids) else order
    ids = ids[first]
    visits, own = (t.column(c).combine_chunks().take(first) for c in ("visits", "own"))
    row = np.repeat(np.arange(len(first)), visits.value_lengths().to_numpy())
    leaf, mine = visits.flatten().to_numpy(), own.flatten().to_numpy(zero_copy_only=False)
    best, who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
    for at in np.unique(leaf):  # leaves of a tree share no own rows, so a pair is found once
        here = leaf == at
        rows = row[here]
        a, b, s = leaf_neighbours(ids[rows], raw[first[rows]], mine[here], k, least, floor=best[rows, -1])
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        nth = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        new, other = np.full((len(rows), k), -np.inf), np.full((len(rows), k), -1, np.int64)
        r = np.searchsorted(ids[rows], a)
        new[r, nth], other[r, nth] = s, b
        new, other = np.hstack([best[rows], new]), np.hstack([who[rows], other])
        order = np.lexsort((other, -new), axis=1)[:, :k]
        best[rows], who[rows] = np.take_along_axis(new, order, 1), np.take_along_axis(other, order, 1)
    r, c = np.nonzero(who >= 0)
    return ids[r], who[r, c], best[r, c]


def leaf_neighbours(ids: np.ndarray, raw: np.ndarray, own: np.ndarray, k: int, least: float | None, tile: int = 32_768, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row id, neighbour id, cosine): for every visitor its ``k`` best own rows of the leaf, compared with all of them.

    Candidates come from single precision blocks and are ranked again in double precision; ``least`` leaves out those
    with a smaller cosine. Ties go to the smaller id. ``floor``: for every visitor a cosine below which none is needed.
    A leaf of any size is compared whole, ``tile`` own rows at a time.
    """
    out = []
    x64 = unit(raw)
    x = x64.astype(np.float32)
    every, mine = np.arange(len(x)), np.flatnonzero(own)
    for first in range(0, len(mine), tile):
        items = mine[first : first + tile]
        y = np.ascontiguousarray(x[items].T)
        wide = min(k + 8, len(items))
        step = block_rows(len(items))
        for at in range(0, len(x), step):
            q = every[at : at + step]
            s = x[q] @ y
            if least is not None:
                r, c = np.nonzero(s >= np.float32(least - 1e-5))
            elif floor is not None:
                fit = s >= (floor[q] - 1e-5).astype(np.float32)[:, None]
                many = np.flatnonzero(np.count_nonzero(fit, axis=1) > wide)
                if len(many):
                    fit[many] = False
                    fit[many[:, None], np.argpartition(s[many], len(items) - wide, axis=1)[:, len(items) - wide :]] = True
                r, c = np.nonzero(fit)
            else:
                c = np.argpartition(s, len(items) - wide, axis=1)[:, len(items) - wide :]
                r, c = np.repeat(np.arange(len(q)), wide), c.ravel()
            a, b = q[r], items[c]
            keep = ids[a] != ids[b]
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            exact = np.einsum("ij,ij->i", x64[a], x64[b])
            if least is not None:
                keep = exact >= least
                a, b, exact = a[keep], b[keep], exact[keep]
            out.append(_best(ids, a, b, exact, k))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    a, b, exact = (np.concatenate(z) for z in zip(*out))
    if len(mine) > tile:
        a, b, exact = _best(ids, a, b, exact, k)
    return ids[a], ids[b], exact


def _best(ids: np.ndarray, a: np.ndarray, b: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (a, b) the ``k`` of highest cosine for every a, ties by the smaller id of b."""
    order = np.lexsort((ids[b], -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return a[rank < k], b[rank < k], exact[rank < k]
