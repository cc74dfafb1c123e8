"""Groups of mutually similar records by hierarchical density clustering.

1. Pieces: every vector goes to one leaf of a tree. There the spanning forest of its mutual-reachability graph is built
   (the first rounds of Boruvka, without a shuffle); what it joins up to ``eps`` is a piece, described by its centroid.
   From here on one row per piece travels, not one per vector.
2. Neighbour graph: the pieces are cut into blocks and every pair of blocks is compared whole in one task. It gives each
   piece's nearest neighbours and the minimum spanning forest of the pair of blocks; a spanning tree of all pieces lies in
   the union of these forests. Two pieces are linked at ``eps`` if any two of their members are: pieces whose centroids
   are further apart than their radii allow can't be, the members of all others are compared. The tasks read blocks and
   members from the staged files, which all executors share, so no vector is shuffled or copied for a comparison.
3. Mutual reachability: an edge weighs max(its distance, the core distances of its ends).
4. Distributed Boruvka: every component takes its lightest edge, pointers are shortened, edges are contracted.
   The edges up to ``eps`` give base groups; the rest, up to ``reach``, joins base groups.
5. Condensed hierarchy over the base groups with stability-based selection; no split below ``eps`` is made.
6. The most persistent members (those that leave last as density rises) are the exemplars.

Distances are 1 - cosine. Up to ``eps`` a piece of several vectors is as far as its nearest member, beyond that as its
centroid. No pair within ``eps`` is left out; the work of step 2 grows with the square of the pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop, stage, tidy
from ..sources.partitioned import open_uri
from . import forest as rp

TINY = 1e-6  # distances below count as this where a density is formed
ROWS = 4096  # of a row group of members


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def leaf_links(x64: np.ndarray, k: int, reach: float, eps: float) -> tuple[np.ndarray, ...]:
    """Of all pairs of the rows of a leaf: (near, its distances, u, v, distance, surely, maybe).

    near: the ``k`` nearest rows of each; (u, v): the spanning forest up to ``reach``; surely and maybe: how many others
    are within ``eps``, with and without room for rounding. A leaf of any size is compared whole, in blocks.
    """
    x = x64.astype(np.float32)
    n = len(x)
    floor, kk = np.float32(1 - reach), min(k, n - 1)
    near = np.empty((n, kk), np.int64)
    surely, maybe = np.empty(n, np.int64), np.empty(n, np.int64)
    first = np.empty(n, np.int64)
    step = rp.block_rows(n)
    for at in range(0, n, step):
        s = x[at : at + step] @ x.T
        m = np.arange(len(s))
        w = slice(at, at + len(s))
        s[m, m + at] = -2
        surely[w] = np.count_nonzero(s >= np.float32(1 - eps + 1e-5), axis=1)
        maybe[w] = np.count_nonzero(s >= np.float32(1 - eps - 1e-5), axis=1)
        for j in range(kk):
            b = s.argmax(1)
            near[w, j] = b
            if j == 0:
                first[w] = np.where(s[m, b] >= floor, b, -1)
            s[m, b] = -2
    parent = list(range(n))
    eu: list[int] = []
    ev: list[int] = []

    def join(pairs):
        for i, j in pairs:
            a, b = _find(parent, i), _find(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                eu.append(i)
                ev.append(j)

    live = np.flatnonzero(first >= 0)
    join(zip(live.tolist(), first[live].tolist()))
    while len(live):  # later rounds: each component's lightest edge to another one
        label = np.array([_find(parent, i) for i in live.tolist()], np.int32)
        y = np.ascontiguousarray(x[live].T)
        best, to = np.empty(len(live), np.float32), np.empty(len(live), np.int64)
        step = rp.block_rows(len(live))
        for at in range(0, len(live), step):
            s = x[live[at : at + step]] @ y
            s[label[at : at + step, None] == label] = -2
            b = s.argmax(1)
            best[at : at + len(s)], to[at : at + len(s)] = s[np.arange(len(s)), b], b
        order = np.lexsort((-best, label))
        head = order[np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))]
        head = head[best[head] >= floor]
        # only components that still have a way out stay in the next round
        going = np.isin(label, label[head]) | np.isin(label, label[to[head]])
        join(zip(live[head].tolist(), live[to[head]].tolist()))
        live = live[going]
    u, v = np.array(eu, np.int64), np.array(ev, np.int64)
    return near, _distances(x64, np.repeat(np.arange(n), kk), near.ravel()).reshape(n, kk), u, v, _distances(x64, u, v), surely, maybe


def _distances(x64: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = np.empty(len(u))
    for at in range(0, len(u), 1 << 16):
        w = slice(at, at + (1 << 16))
        d[w] = np.maximum(1 - np.einsum("ij,ij->i", x64[u[w]], x64[v[w]]), 0)
    return d


def leaf_pieces(ids: np.ndarray, raw: np.ndarray, k: int, eps: float) -> tuple[np.ndarray, ...]:
    """(piece, core, size, full, centroid, radius) for every row of a leaf; the last four hold where ``ids`` equals ``piece``.

    A piece is what mutual reachability joins up to ``eps``, named by its smallest id. core: the distance of the k-th
    nearest row, NaN for a piece of one. full: every two members are within ``eps`` of one another and of no other row
    of the leaf. radius: the largest angle between the centroid and a member, 0 for a piece of one only.
    """
    n = len(ids)
    x64 = rp.unit(raw)
    if n == 1:
        return ids, np.array([np.nan]), np.array([1]), np.array([True]), np.array(raw, np.float32), np.zeros(1)
    near, nd, u, v, d, surely, maybe = leaf_links(x64, k, eps, eps)
    core = nd[:, k - 1] if nd.shape[1] >= k else np.full(n, np.inf)
    a, b = np.append(np.repeat(np.arange(n), nd.shape[1]), u), np.append(near.ravel(), v)
    w = np.maximum(np.append(nd.ravel(), d), np.maximum(core[a], core[b]))
    parent = list(range(n))
    for i, j in zip(a[w <= eps].tolist(), b[w <= eps].tolist()):
        p, q = _find(parent, i), _find(parent, j)
        parent[max(p, q)] = min(p, q)
    label = np.array([_find(parent, i) for i in range(n)])
    size = np.bincount(label, minlength=n)[label]
    whole = (surely == maybe) & (surely == size - 1)
    full = np.bincount(label, whole, minlength=n)[label] == size
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    sums = np.zeros((n, raw.shape[1]))
    np.add.at(sums, label, x64)
    # a single vector stays as it is; centroids of unit vectors that cancel out keep a member's direction
    flat = np.linalg.norm(sums, axis=1) < 1e-9
    sums[flat] = x64[flat]
    centroid = np.where((size > 1)[:, None], sums[label], raw).astype(np.float32)
    angle = np.arccos(np.clip(np.einsum("ij,ij->i", x64, rp.unit(centroid)), -1, 1)) + 1e-6
    radius = np.zeros(n)
    np.maximum.at(radius, label, np.where(size > 1, angle, 0))
    return low[label], np.where(size > 1, core, np.nan), size, full, centroid, radius[label]


def copies_of(vectors: DataFrame) -> DataFrame:
    """(id, rid, n): every id, the smallest id with the very same vector, and how many ids share it."""
    ids = stage(rp.members(vectors), "ids")
    groups = ids.groupBy("h1", "h2").agg(F.min("id").alias("rid"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ids.join(groups, ["h1", "h2"], "left").select("id", F.coalesce("rid", "id").alias("rid"), F.coalesce("n", F.lit(1)).alias("n"))


def pieces_of(vectors: DataFrame, dim: int, k: int, eps: float, leaf_size: int, max_sample: int, seed: int) -> DataFrame:
    """(rid, piece, core, size, full, own, vec, radius), one row per distinct vector; size, full and radius where rid = piece, vec
    (the centroid) where such a piece has several members.

    The members of a piece stand together in one file, the first at its smallest id: :func:`member_reader` finds them by position.
    """
    spark = vectors.sparkSession
    forest = rp.build(vectors, dim, 1, leaf_size, max_sample, seed)
    placed = rp.place(vectors, forest, dim, 1)

    def local(t):
        import pyarrow as pa

        rid, raw, _ = rp.merge_copies(t, dim)
        if not len(rid):
            piece, core, size, full, vec, radius = rid, np.zeros(0), rid, np.zeros(0, bool), np.zeros((0, dim), np.float32), np.zeros(0)
        else:
            piece, core, size, full, vec, radius = leaf_pieces(rid, raw, k, eps)
        order = np.lexsort((rid, piece))
        rid, raw, piece, core, size, full, vec, radius = (c[order] for c in (rid, raw, piece, core, size, full, vec, radius))
        head = piece == rid
        vecs = [v.tobytes() if h else None for v, h in zip(vec, head & (size > 1))]
        return pa.table({
            "rid": rid, "piece": piece, "core": pa.array(core, from_pandas=True), "size": pa.array(size, pa.int64(), mask=~head), "full": pa.array(full, mask=~head),
            "own": pa.array([v.tobytes() for v in raw], pa.binary()), "vec": pa.array(vecs, pa.binary()), "radius": pa.array(radius, mask=~head),
        })

    schema = "rid bigint, piece bigint, core double, size bigint, full boolean, own binary, vec binary, radius double"
    out = stage(placed.groupBy("leaf").applyInArrow(local, schema), "pieces", **{"parquet.block.row.count.limit": str(ROWS)})
    tidy(spark)
    return out


def spanning(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j, d) form their minimum spanning forest."""
    nodes, ends = np.unique(np.append(i, j), return_inverse=True)
    a, b = ends[: len(i)], ends[len(i) :]
    parent, order, taken = list(range(len(nodes))), np.argsort(d, kind="stable"), np.zeros(len(i), bool)
    at, step = 0, max(len(nodes), 1024)
    while at < len(order):
        part = order[at : at + step]
        label = np.array([_find(parent, x) for x in range(len(nodes))])
        for e in part[label[a[part]] != label[b[part]]].tolist():  # the others close a cycle
            p, q = _find(parent, int(a[e])), _find(parent, int(b[e]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                taken[e] = True
        at, step = at + step, 2 * step
    return taken


def nearest_ends(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, other, position of the edge): for every end of the edges (i, j, d) its ``k`` lightest."""
    row, other, edge = np.append(i, j), np.append(j, i), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((other, d[edge], row))
    row, other, edge = row[order], other[order], edge[order]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
    first = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row)))) < k
    return row[first], other[first], edge[first]


def pairs_above(x: np.ndarray, y: np.ndarray, floor: np.ndarray, tall: int = 512, wide: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(r, c), in order of r and c: all pairs of a row of ``x`` and one of ``y`` whose product is at least ``floor[r]``.

    The products are formed in tiles that stay in a core's cache; only rows whose largest product is that high are looked through.
    """
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(x), tall):
        a, low = x[at : at + tall], floor[at : at + tall]
        out, top = np.empty((len(a), wide), np.float32), np.empty(len(a), np.float32)
        for to in range(0, len(y), wide):
            b = y[to : to + wide]
            s = out if len(b) == wide else np.empty((len(a), len(b)), np.float32)
            np.max(np.dot(a, b.T, out=s), axis=1, out=top)
            hit = np.flatnonzero(top >= low)
            if len(hit):
                r, c = np.nonzero(s[hit] >= low[hit, None])
                rows.append(at + hit[r])
                cols.append(to + c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    order = np.lexsort((c, r))
    return r[order], c[order]


def block_links(x64: np.ndarray, radius: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, reach: float, eps: float, limit: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Of all pairs of a ``left`` and a ``right`` row, or of all of ``left`` if both are the same: (i, j, d, to ask).

    (i, j, d): the pairs up to ``reach`` that are in the spanning forest or are one of the ``k`` nearest of an end; d is
    above ``eps`` where one of them has a radius. to ask: (2, n) pairs with a radius whose members may be within ``eps``.
    """
    above, theta, same = eps + 1e-9, np.arccos(max(1 - eps, -1)), left is right  # clear of the room that closed_groups leaves for rounding
    x = x64.astype(np.float32)
    y = x[right]
    widest = radius[right].max(initial=0)
    floor = (np.minimum(1 - reach, np.cos(np.minimum(theta + radius[left] + widest, np.pi))) - 1e-5).astype(np.float32)
    i, j, d, asked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), []
    step = rp.block_rows(len(right))
    for at in range(0, len(left), step):
        lo = at if same else 0
        r, c = pairs_above(x[left[at : at + step]], y[lo:], floor[at : at + step])
        a, b = left[at + r], right[lo + c]
        if same:
            a, b = a[at + r < lo + c], b[at + r < lo + c]
        far, both = _distances(x64, a, b), radius[a] + radius[b]
        ask = (both > 0) & (far <= 1 - np.cos(np.minimum(theta + both, np.pi)) + 1e-9)
        asked.append(np.stack([a[ask], b[ask]]))
        far = np.where(both > 0, np.maximum(far, above), far)
        near = far <= reach
        i, j, d = np.append(i, a[near]), np.append(j, b[near]), np.append(d, far[near])
        if len(i) > limit or at + step >= len(left):
            keep = lightest(i, j, d, k)
            i, j, d = i[keep], j[keep], d[keep]
            limit = max(limit, 2 * len(i))
    return i, j, d, np.concatenate(asked, 1) if asked else np.zeros((2, 0), np.int64)


def member_reader(dim: int, keep: int = 64) -> Callable[[str, int, int], np.ndarray]:
    """A function (file, first row, rows) -> these members of the table of :func:`pieces_of`; the last ``keep`` row groups read stay in memory."""
    import pyarrow.parquet as pq

    @lru_cache(16)
    def opened(uri):
        system, path = open_uri(uri)
        pf = pq.ParquetFile(system.open_input_file(path))
        return pf, np.cumsum([0] + [pf.metadata.row_group(i).num_rows for i in range(pf.num_row_groups)])

    @lru_cache(keep)
    def group(uri, i):
        return rp.as_matrix(opened(uri)[0].read_row_group(i, columns=["own"]).column("own"), dim)

    def read(uri, first, rows):
        starts, out = opened(uri)[1], []
        for i in range(int(np.searchsorted(starts, first, "right")) - 1, len(starts) - 1):
            if starts[i] >= first + rows:
                break
            out.append(group(uri, i)[max(first - starts[i], 0) : first + rows - starts[i]])
        return out[0] if len(out) == 1 else np.concatenate(out)

    return read


def nearest_members(a: np.ndarray, b: np.ndarray, eps: float, best: float = np.inf) -> float:
    """The distance of the nearest two unit rows of ``a`` and ``b`` if it is within ``eps`` and below ``best``, else ``best`` or more."""
    y, step = np.ascontiguousarray(b.T.astype(np.float32)), rp.block_rows(len(b))
    for at in range(0, len(a), step):
        s = a[at : at + step].astype(np.float32) @ y
        top = s.max()
        if top >= 1 - min(eps, best) - 1e-5:
            r, c = np.nonzero(s >= top - np.float32(1e-5))
            best = min(best, max(1 - np.einsum("ij,ij->i", a[at + r], b[c]).max(), 0.0))
    return best


def member_links(ask: np.ndarray, where: tuple[np.ndarray, ...], read: Callable[[str, int, int], np.ndarray], eps: float, block: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """(which, d): those of the pairs of pieces ``ask`` (2, n) with members within ``eps``, and the distance of the nearest two.

    ``where``: every piece's (file, first row, rows). At most ``block`` members of each piece are looked at at once.
    """
    file, first, rows = where
    _, number = np.unique(file, return_inverse=True)
    which, d = [], []
    # pairs with near places follow one another, so that few row groups are read again
    for e in np.lexsort((first[ask[1]], number[ask[1]], first[ask[0]] // ROWS, number[ask[0]])).tolist():
        u, v = ask[:, e].tolist()
        best = np.inf
        for p in range(0, rows[u], block):
            a = rp.unit(read(file[u], first[u] + p, min(block, rows[u] - p)))
            for q in range(0, rows[v], block):
                best = nearest_members(a, rp.unit(read(file[v], first[v] + q, min(block, rows[v] - q))), eps, best)
        if best <= eps:
            which.append(e)
            d.append(best)
    return np.array(which, np.int64), np.array(d, np.float64)


def lightest(u: np.ndarray, v: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Which of the edges (u, v, d) are in the spanning forest or one of the ``k`` nearest of an end."""
    keep = spanning(u, v, d)
    keep[nearest_ends(u, v, d, k)[2]] = True
    return keep


def neighbour_graph(nodes: DataFrame, dim: int, min_samples: int, reach: float, eps: float) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, d, w), u < v, at most ``reach`` apart, with distance and mutual-reachability weight, and the core
    distances (x, core).

    ``nodes``: a staged table (id, vec, ``radius``, ``n`` records, ``core`` or null, and ``file``, ``row`` and ``size`` of its
    members), one per piece, whose files are the blocks. A node without a core distance of its own gets that of its
    neighbours' records. All pairs are compared: a task reads pairs of blocks one after another, of up to eight by
    eight blocks where there are many, and keeps the edges that may matter.
    """
    spark = nodes.sparkSession
    files = sorted(nodes.inputFiles())
    wide = min(8, max(1, len(files) // 16))
    parts = spark.createDataFrame([(i, files[at : at + wide]) for i, at in enumerate(range(0, len(files), wide))], "p int, pf array<string>")
    parts = parts.join(F.broadcast(parts.select(F.col("p").alias("q"), F.col("pf").alias("qf"))), F.col("p") <= F.col("q"))  # names only
    count = -(-len(files) // wide)
    parts = parts.repartitionByRange(max(1, min(count * (count + 1) // 2, 4096)), "p", "q").select("pf", "qf")

    def block(uri):
        import pyarrow.parquet as pq

        system, path = open_uri(uri)
        with system.open_input_file(path) as f:
            t = pq.read_table(f, columns=["id", "vec", "radius", "file", "row", "size"])
        return t.column("vec"), *(t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "radius", "file", "row", "size"))

    def compare(pf, qf, read):
        u, v, d, lu, lv, ld = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64) * 2)
        limit = 1 << 20
        for x in pf:
            one = block(x)
            for y in qf:
                if x > y:
                    continue  # both sides are the same blocks: the pair comes the other way round
                two = [c[:0] for c in one] if x == y else block(y)
                x64 = rp.unit(np.concatenate([rp.as_matrix(one[0], dim), rp.as_matrix(two[0], dim)]))
                ids, radius, *where = (np.concatenate([a, b]) for a, b in zip(one[1:], two[1:]))
                left = np.arange(len(one[1]))
                i, j, w, ask = block_links(x64, radius, left, left if x == y else np.arange(len(left), len(ids)), min_samples, reach, eps)
                which, near = member_links(ask, where, read, eps)
                u, v, d = np.append(u, ids[i]), np.append(v, ids[j]), np.append(d, w)
                lu, lv, ld = np.append(lu, ids[ask[0, which]]), np.append(lv, ids[ask[1, which]]), np.append(ld, near)
                if len(u) > limit:
                    keep = lightest(u, v, d, min_samples)
                    u, v, d = u[keep], v[keep], d[keep]
                    limit = max(limit, 2 * len(u))
        tree = spanning(u, v, d)
        row, other, edge = nearest_ends(u, v, d, min_samples)
        a, b = np.append(u[tree], lu), np.append(v[tree], lv)
        a, b = np.append(np.minimum(a, b), row), np.append(np.maximum(a, b), other)
        return a, b, np.concatenate([d[tree], ld, d[edge]]), np.repeat(np.array([0, 1, 2], np.int32), [tree.sum(), len(lu), len(row)])

    def local(batches: Iterable) -> Iterator:
        import pyarrow as pa

        read = member_reader(dim)
        for t in batches:
            for pf, qf in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in compare(pf, qf, read)], names=["u", "v", "d", "kind"])

    raw = stage(parts.mapInArrow(local, "u bigint, v bigint, d double, kind int"), "blockedges")
    links = raw.filter("kind = 1").select("u", "v", "d")
    tidy(spark)
    given = nodes.filter("core is not null").select(F.col("id").alias("x"), "core")
    many = nodes.filter("n > 1").select(F.col("id").alias("m"), F.col("n").alias("n_m"))
    open_ = nodes.filter("core is null").select(F.col("id").alias("x"), (F.col("n") - 1).alias("own"))
    linked = links.select(F.explode(F.array(F.struct("u", "v", "d"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "d"))).alias("x")).select("x.*")
    near = raw.filter("kind = 2").select("u", "v", "d").unionByName(linked).groupBy("u", "v").agg(F.min("d").alias("d"))
    counted = near.join(open_, near["u"] == open_["x"])
    counted = counted.join(many, counted["v"] == many["m"], "left").select("u", "own", "d", "v", F.coalesce("n_m", F.lit(1)).alias("n_v"))
    upto = F.sum("n_v").over(Window.partitionBy("u").orderBy("d", "v").rowsBetween(Window.unboundedPreceding, 0))
    found = counted.withColumn("upto", upto).groupBy("u").agg(F.min(F.when(F.col("own") + F.col("upto") >= min_samples, F.col("d"))).alias("core"))
    core = stage(given.unionByName(found.filter("core is not null").select(F.col("u").alias("x"), "core")), "cores")
    e = raw.filter("kind = 0").select("u", "v", "d").unionByName(links)
    if min_samples > 2:  # up to two, every inner row of a path in the forest is dense itself
        e = e.unionByName(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d"))
    e = e.groupBy("u", "v").agg(F.min("d").alias("d"))
    a, b = core.select(F.col("x").alias("xa"), F.col("core").alias("ca")), core.select(F.col("x").alias("xb"), F.col("core").alias("cb"))
    far = F.lit(2.0)  # fewer than min_samples neighbours within reach: dense at no distance looked at
    g = e.join(a, e["u"] == a["xa"], "left").join(b, e["v"] == b["xb"], "left")
    graph = stage(g.select("u", "v", "d", F.greatest("d", F.coalesce("ca", far), F.coalesce("cb", far)).alias("w")), "graph")
    drop(raw)
    return graph, core


def boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree edges (u, v, w), not evaluated yet, and labels (node, c)) of the minimum spanning forest of ``edges`` (u, v, w), u < v.

    ``labels`` has the nodes of ``edges``; c is one node of the component. Equal weights are ordered by the ends, so no
    cycle can be chosen. Every round at least halves the components that have edges; its pointers are kept and
    composed at the end, from the few last components up.
    """
    spark = edges.sparkSession
    e = stage(edges.select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.struct("w", "u", "v").alias("e")), "contracted")
    chosen, rounds = [], []
    while not e.isEmpty():
        ends = e.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("cv").alias("to"), "e"), F.struct(F.col("cv").alias("c"), F.col("cu").alias("to"), "e"))).alias("x")).select("x.*")
        best = stage(ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("b")).select("c", "b.e", "b.to"), "lightest")
        chosen.append(best.select("e.u", "e.v", "e.w"))
        # pointers form trees around one mutual pair each; its smaller end is the root
        back = best.select(F.col("c").alias("c2"), F.col("to").alias("to2"))
        root = (F.col("to2") == F.col("c")) & (F.col("c") < F.col("to"))
        p = stage(best.join(back, best["to"] == back["c2"]).select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("p"), root.alias("done")), "pointers")
        while not (live := p.filter(~F.col("done"))).isEmpty():  # a pointer is done once it is known to name a root
            q = p.select(F.col("c").alias("c2"), F.col("p").alias("p2"), F.col("done").alias("d2"))
            moved = live.join(q, live["p"] == q["c2"]).select("c", F.col("p2").alias("p"), F.col("d2").alias("done"))
            p = stage(p.filter("done").unionByName(moved), "pointers")
        rounds.append(p.select("c", "p"))
        pu, pv = p.select(F.col("c").alias("x"), F.col("p").alias("pu")), p.select(F.col("c").alias("y"), F.col("p").alias("pv"))
        moved = e.join(pu, e["cu"] == pu["x"]).join(pv, e["cv"] == pv["y"]).select(F.col("pu").alias("a"), F.col("pv").alias("b"), "e").filter("a <> b")
        e = stage(moved.groupBy(F.least("a", "b").alias("cu"), F.greatest("a", "b").alias("cv")).agg(F.min("e").alias("e")), "contracted")
        tidy(spark)
    if not rounds:
        return edges.select("u", "v", "w").limit(0), edges.select(F.col("u").alias("node"), F.col("u").alias("c")).limit(0)
    m = rounds[-1]
    for r in reversed(rounds[:-1]):
        up = m.select(F.col("c").alias("c2"), F.col("p").alias("p2"))
        m = stage(r.join(up, r["p"] == up["c2"], "left").select("c", F.coalesce("p2", "p").alias("p")), "labels")
    return reduce(DataFrame.unionByName, chosen).distinct(), m.select(F.col("c").alias("node"), F.col("p").alias("c"))


def condense(nodes: list[tuple[int, int, float]], edges: list[tuple[float, int, int]], min_size: int, reach: float) -> dict[int, int]:
    """Base group -> chosen cluster (its smallest base group) of one component.

    ``nodes``: (base group, records, sum of the records' densities); ``edges``: spanning tree over them. Cutting the
    edges from the heaviest on splits a cluster where both sides have ``min_size`` records; a smaller side falls out. A
    cluster's stability is the sum over its records of density at leaving less density at birth; a cluster is chosen
    over its parts if it is more stable than all chosen among them together. Base groups that fall out of every chosen
    cluster get no entry.
    """
    size = {b: n for b, n, _ in nodes}
    dens = {b: s for b, _, s in nodes}
    # merge tree: built from the lightest edge up
    parent = {b: b for b in size}
    top: dict[int, int] = {b: b for b in size}  # root -> tree node
    kids: dict[int, tuple[int, int, float]] = {}
    count = dict(size)
    nid = -1

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for w, a, b in sorted(edges):
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        kids[nid] = (top[ra], top[rb], w)
        count[nid] = count[top[ra]] + count[top[rb]]
        parent[rb] = ra
        top[ra] = nid
        nid -= 1
    chosen: dict[int, int] = {}
    for root in {top[find(b)] for b in size}:
        if count[root] < min_size:
            continue
        # clusters in order of birth: [tree node, birth density, stability, child clusters, own base groups]
        made = [[root, 1 / reach, 0.0, [], []]]
        i = 0
        while i < len(made):
            c = made[i]
            birth, work = c[1], [c[0]]
            while work:
                t = work.pop()
                if t not in kids:
                    c[2] += dens[t] - size[t] * birth
                    c[4].append(t)
                    continue
                a, b, w = kids[t]
                lam = 1 / max(w, TINY)
                big = [x for x in (a, b) if count[x] >= min_size]
                if len(big) == 2:
                    c[2] += count[t] * (lam - birth)
                    for x in big:
                        made.append([x, lam, 0.0, [], []])
                        c[3].append(len(made) - 1)
                elif big:
                    small = b if big[0] == a else a
                    c[2] += count[small] * (lam - birth)
                    work.append(big[0])
                else:
                    c[2] += count[t] * (lam - birth)
            i += 1
        take = [False] * len(made)
        score = [0.0] * len(made)
        for i in range(len(made) - 1, -1, -1):
            parts = sum(score[j] for j in made[i][3])
            take[i] = not made[i][3] or made[i][2] > parts
            score[i] = made[i][2] if take[i] else parts
        work = [0]
        while work:
            i = work.pop()
            if not take[i]:
                work += made[i][3]
                continue
            inside, below = [], [i]
            while below:
                j = below.pop()
                inside += made[j][4]
                below += made[j][3]
            if inside:
                name = min(inside)
                chosen |= {b: name for b in inside}
    return chosen


def density_groups(
    rows: DataFrame, id_col: str, vec_col: str, dim: int = 64, min_samples: int = 2, min_size: int = 3, eps: float = 0.14, reach: float = 0.5,
    leaf_size: int = 8192, max_sample: int = 131_072, seed: int = 0, block: int = 65_536,
) -> dict[str, DataFrame]:
    """``labels`` (id, rid, base, cluster, density), and ``vectors``, ``graph``, ``pieces`` and ``base`` for further checks.

    base: the group connected by mutual reachability up to ``eps`` (its own rid if it is alone); cluster: the base
    group's chosen cluster, null for noise. Ids with the same vector share everything; a vector held by a third of all
    ids is one node whose weight is its number of ids. Unusable vectors take no part. Empty tables give empty results.
    """
    spark = rows.sparkSession
    vectors = rp.usable_vectors(rows, id_col, vec_col, dim)
    ids = stage(copies_of(vectors), "ids")
    pieces = pieces_of(vectors, dim, min_samples, eps, leaf_size, max_sample, seed)
    # further copies count towards a piece's records
    more = ids.filter("id = rid and n > 1").select(F.col("rid").alias("r1"), (F.col("n") - 1).alias("copies"))
    weighty = pieces.select("rid", "piece").join(more, F.col("rid") == F.col("r1")).groupBy("piece").agg(F.sum("copies").alias("copies")).withColumnRenamed("piece", "p1")
    spread = pieces.filter("rid <> piece").groupBy(F.col("piece").alias("p2")).agg(F.max("core").alias("core"))  # a piece is as dense as where it hangs together
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    nodes = pieces.filter("rid = piece").select(F.col("piece").alias("id"), F.coalesce("vec", "own").alias("vec"), "size", "radius", *place)
    nodes = nodes.join(weighty, F.col("id") == F.col("p1"), "left").join(spread, F.col("id") == F.col("p2"), "left")
    n = F.col("size") + F.coalesce("copies", F.lit(0))
    nodes = nodes.select("id", "vec", "radius", n.alias("n"), F.when((F.col("size") == 1) & (n > min_samples), 0.0).otherwise(F.col("core")).alias("core"), "file", "row", "size")
    count = pieces.filter("rid = piece").count()
    blocks = max(-(-count // block), min(4, -(-count // 2048)), 1)  # some blocks at least, so that there are tasks to share
    nodes = stage(nodes.repartitionByRange(blocks, "file", "row"), "nodes")  # members of a block stand together too
    graph, core = neighbour_graph(nodes, dim, min_samples, reach, eps)
    tidy(spark)
    _, labels = boruvka(graph.filter(F.col("w") <= eps).select("u", "v", "w"))
    base = nodes.select(F.col("id").alias("piece"), "n").join(labels, F.col("piece") == F.col("node"), "left").select("piece", "n", F.coalesce("c", "piece").alias("base"))
    base = stage(base.join(core, F.col("piece") == F.col("x"), "left").select("piece", "n", "base", "core"), "base")
    # a record's density is that of its core distance; a vector that isn't dense within eps counts as if just there
    lone = F.when(F.col("core") <= eps, 1 / F.greatest("core", F.lit(TINY))).otherwise(F.lit(1 / eps))
    nodes = stage(base.groupBy("base").agg(F.sum("n").cast("bigint").alias("size"), F.sum(lone * F.col("n")).alias("dens")), "bases")
    if reach > eps:
        lu, lv = labels.select(F.col("node").alias("nu"), F.col("c").alias("bu")), labels.select(F.col("node").alias("nv"), F.col("c").alias("bv"))
        outer = graph.filter((F.col("w") > eps) & (F.col("w") <= reach))
        outer = outer.join(lu, outer["u"] == lu["nu"], "left").join(lv, outer["v"] == lv["nv"], "left").select(F.coalesce("bu", "u").alias("a"), F.coalesce("bv", "v").alias("b"), "w").filter("a <> b")
        outer = outer.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("w").alias("w"))
        joins, comps = boruvka(stage(outer, "outer"))
        lone_groups = nodes.join(comps, nodes["base"] == comps["node"], "left_anti").filter(F.col("size") >= min_size).select("base", F.col("base").alias("cluster"))
        marked = nodes.join(comps, nodes["base"] == comps["node"]).select(F.col("c").alias("comp"), "base", "size", "dens", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("w"))
        c2 = comps.select(F.col("node").alias("nn"), F.col("c").alias("comp"))
        ties = joins.join(c2, joins["u"] == c2["nn"]).select("comp", F.col("u").alias("base"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("double").alias("dens"), F.col("v").alias("b"), "w")

        def choose(batches):
            import pyarrow as pa

            held: list = []  # rows of the component under way; rows come sorted by component

            def done():
                own = [(r["base"], r["size"], r["dens"]) for r in held if r["b"] is None]
                return condense(own, [(r["w"], r["base"], r["b"]) for r in held if r["b"] is not None], min_size, reach)

            for part in batches:
                got: dict[int, int] = {}
                for r in part.to_pylist():
                    if held and held[0]["comp"] != r["comp"]:
                        got |= done()
                        held.clear()
                    held.append(r)
                yield pa.RecordBatch.from_pydict({"base": pa.array(list(got), pa.int64()), "cluster": pa.array(list(got.values()), pa.int64())})
            if held:
                got = done()
                yield pa.RecordBatch.from_pydict({"base": pa.array(list(got), pa.int64()), "cluster": pa.array(list(got.values()), pa.int64())})

        # one row per base group or join, not per record; a task goes through its components one after another
        sorted_ = marked.unionByName(ties).repartition("comp").sortWithinPartitions("comp")
        chosen = sorted_.mapInArrow(choose, "base bigint, cluster bigint").unionByName(lone_groups)
    else:
        chosen = nodes.filter(F.col("size") >= min_size).select("base", F.col("base").alias("cluster"))
    chosen = chosen.withColumnRenamed("base", "b2")
    base = stage(base.join(chosen, base["base"] == chosen["b2"], "left").select(F.col("piece").alias("p1"), "base", "cluster", "core"), "members")
    # a member of a piece has a core distance of its own, any other row that of its node
    own = F.coalesce(pieces["core"], base["core"])
    density = F.when(own <= eps, 1 / F.greatest(own, F.lit(TINY))).otherwise(F.lit(1 / eps))
    full = stage(pieces.join(base, pieces["piece"] == base["p1"]).select(F.col("rid").alias("r2"), "base", "cluster", density.alias("density")), "vectors")
    # ids that are their vector's smallest have their row already; only further copies are looked up
    first = full.select(F.col("r2").alias("id"), F.col("r2").alias("rid"), "base", "cluster", "density")
    more = stage(ids.filter("id <> rid").select("id", "rid"), "further")
    labels = first.unionByName(more.join(full, more["rid"] == full["r2"]).select("id", "rid", "base", "cluster", "density"))
    tidy(spark)
    return {"labels": labels, "vectors": vectors, "graph": graph, "pieces": pieces, "base": base}


def closed_groups(found: dict[str, DataFrame], dim: int, least: float, min_size: int = 3, block: int = 16_384) -> DataFrame:
    """(id, base) of base groups whose vectors are all at least ``least`` similar to one another and to none outside.

    ``found``: from :func:`density_groups` with ``eps`` = 1 - ``least``. Groups that are one piece were compared in its leaf.
    Of the others the vectors are cut into blocks of about ``block`` rows and every pair of blocks is compared in one
    task, so no task holds more than two blocks whatever the group's size.
    """
    labels, graph = found["labels"], found["graph"]
    sizes = labels.groupBy("base").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("id") == F.col("rid"), 1)).alias("reps")).filter(F.col("size") >= min_size)
    # an edge of similar nodes that leaves a group: only edges at an end that is not dense can do so
    node = found["base"].select(F.col("p1").alias("n1"), F.col("base").alias("b1"))
    cross = graph.filter((F.col("d") <= 1 - least + 1e-12) & (F.col("w") > 1 - least))
    n2 = node.select(F.col("n1").alias("n2"), F.col("b1").alias("b2"))
    cross = cross.join(node, cross["u"] == node["n1"]).join(n2, cross["v"] == n2["n2"]).filter("b1 <> b2")
    open_ = cross.select(F.explode(F.array("b1", "b2")).alias("base")).distinct()
    fit = stage(sizes.join(open_, "base", "left_anti"), "candidates")
    # a group that is one piece was compared in its leaf
    done = found["pieces"].filter("rid = piece and full").select(F.col("piece").alias("p2"), F.col("size").alias("reps"))
    known = done.join(found["base"], F.col("p2") == F.col("p1")).select("base", "reps")
    unknown = stage(fit.filter("reps > 1").join(known, ["base", "reps"], "left_anti"), "unchecked")
    verdict = stage(_compare_blocks(found["vectors"], labels, unknown, dim, least, block, True), "verdicts")
    failed, unsure = verdict.filter("bad").select("base").distinct(), verdict.filter("not bad").select("base").distinct()
    if not unsure.isEmpty():  # too near the limit for rounded vectors
        again = unknown.join(unsure, "base", "left_semi").join(failed, "base", "left_anti")
        failed = failed.unionByName(_compare_blocks(found["vectors"], labels, again, dim, least, block, False).filter("bad").select("base")).distinct()
    good = fit.join(failed, "base", "left_anti").select("base")
    return labels.join(good, "base").select("id", "base")


def _compare_blocks(vectors: DataFrame, labels: DataFrame, groups: DataFrame, dim: int, least: float, block: int, rounded: bool) -> DataFrame:
    """(base, bad): pairs of blocks of a group with a pair below ``least`` (bad), or with one that can't be told (not bad).

    ``rounded`` vectors travel as one byte per number with the length of their rounding error, which bounds the error of
    every cosine; others travel whole, and every pair can be told.
    """

    def shrink(batches):
        import pyarrow as pa

        for b in batches:
            x = rp.unit(rp.as_matrix(b.column(1), dim))
            step = np.abs(x).max(1) / 127 if len(x) else np.zeros(0)
            q = np.rint(x / step[:, None]).astype(np.int8)
            err = np.linalg.norm(x - q * step[:, None], axis=1)
            at = pa.py_buffer(np.arange(0, (len(x) + 1) * dim, dim, dtype=np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), packed, pa.array(step), pa.array(err)], names=["id", "vec", "step", "err"])

    if rounded:
        vectors = vectors.mapInArrow(shrink, "id bigint, vec binary, step double, err double")
    else:
        vectors = vectors.select("id", "vec", F.lit(0.0).alias("step"), F.lit(0.0).alias("err"))
    reps = labels.filter("id = rid").join(groups, "base").select("rid", "base", F.ceil(F.col("reps") / block).cast("int").alias("blocks"))
    v = vectors.join(reps, vectors["id"] == reps["rid"]).select("rid", "base", "vec", "step", "err", "blocks", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("mine"))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("base", "vec", "step", "err", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))

    def check(key, t):
        import pyarrow as pa

        mine, err = t.column("mine").to_numpy(), t.column("err").to_numpy()
        if rounded:
            packed = t.column("vec").combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            first = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
            x64 = np.frombuffer(packed.buffers()[2], np.int8, len(packed) * dim, first).reshape(-1, dim) * t.column("step").to_numpy()[:, None]
        else:
            x64 = rp.unit(rp.as_matrix(t.column("vec"), dim))
        x = x64.astype(np.float32)
        a, b = np.flatnonzero(mine == key[1].as_py()), np.flatnonzero(mine == key[2].as_py())
        y, worst, unsure = np.ascontiguousarray(x[b].T), float(err.max(initial=0)), False
        for at in range(0, len(a), rp.BLOCK):
            s = x[a[at : at + rp.BLOCK]] @ y
            r, c = np.nonzero(s < np.float32(least + 2 * worst + worst * worst + 1e-5))
            if not len(r):
                continue
            i, j = a[at + r], b[c]
            exact, room = np.einsum("ij,ij->i", x64[i], x64[j]), err[i] + err[j] + err[i] * err[j]
            if (exact + room < least).any():
                return pa.table({"base": pa.array([key[0].as_py()], pa.int64()), "bad": [True]})
            unsure |= bool((exact - room < least).any())
        return pa.table({"base": pa.array([key[0].as_py()] * unsure, pa.int64()), "bad": pa.array([False] * unsure, pa.bool_())})

    return v.groupBy("base", "p", "q").applyInArrow(check, "base bigint, bad boolean")
