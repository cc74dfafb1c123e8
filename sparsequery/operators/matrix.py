"""Lazy sparse matrix over a table of (row id, column id, value), with implicit zeros in its reductions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selectors import Selector, TableSelector, compose, normalize, parse_key

CELL, GENE, VALUE = "cell_integer_id", "gene_integer_id", "value"
MAX_DENSE = 1 << 28  # numbers of an array on the driver


@dataclass(frozen=True)
class LazyMatrix:
    """A view: the table, the measure, one selector per axis and an ordered list of transforms.

    Absent pairs and null measures are zeros. Every operation returns a plan or a new view; only the methods that
    return NumPy arrays run something.
    """

    source: DataFrame
    shape_all: tuple[int, int]
    value: str = VALUE
    rows: Selector | TableSelector = None
    cols: Selector | TableSelector = None
    transforms: tuple[tuple[str, float | None], ...] = field(default=())

    def __post_init__(self):
        n, m = self.shape_all
        object.__setattr__(self, "rows", normalize(self.rows, n))
        object.__setattr__(self, "cols", normalize(self.cols, m))

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.cols)

    def __getitem__(self, key: Any) -> LazyMatrix:
        a, b = parse_key(key)
        return replace(self, rows=compose(self.rows, a), cols=compose(self.cols, b))

    def normalize_total(self, target_sum: float | None = 1e4) -> LazyMatrix:
        """Values scaled so that every whole row sums to ``target_sum``, whatever columns are selected."""
        t = 1e4 if target_sum is None else float(target_sum)
        if t <= 0:
            raise ValueError("target_sum must be above 0")
        return replace(self, transforms=(*self.transforms, ("normalize_total", t)))

    def log1p(self) -> LazyMatrix:
        return replace(self, transforms=(*self.transforms, ("log1p", None)))

    def keep_transforms(self, names: list[str] | None = None) -> LazyMatrix:
        """Only the named transforms, in their order; None drops all."""
        return replace(self, transforms=tuple(t for t in self.transforms if t[0] in (names or ())))

    def df(self) -> DataFrame:
        """(cell_integer_id, gene_integer_id, value double) of the stored rows of the view, each selected id once.

        Row selectors are applied before the transforms (a row's total needs only its own entries), column selectors
        after them.
        """
        d = self.rows.apply(self.source.select(CELL, GENE, F.col(self.value).cast("double").alias(VALUE)), CELL).filter(F.col(VALUE).isNotNull())
        for name, arg in self.transforms:
            if name == "normalize_total":
                # totals are one row per cell: small ones are broadcast, so the entries aren't moved
                total = d.groupBy(F.col(CELL).alias("__c")).agg(F.sum(VALUE).alias("__t"))
                d = d.join(total, F.col(CELL) == F.col("__c")).select(CELL, GENE, F.coalesce(F.try_divide(F.col(VALUE), F.col("__t")) * F.lit(arg), F.lit(0.0)).alias(VALUE))
            else:
                d = d.withColumn(VALUE, F.log1p(VALUE))
        return self.cols.apply(d, GENE)

    # reductions as plans

    def _axis(self, axis: int) -> tuple[str, Selector, int]:
        if axis not in (0, 1):
            raise ValueError("axis is 0, 1 or None")
        return (GENE, self.cols, len(self.rows)) if axis == 0 else (CELL, self.rows, len(self.cols))

    @staticmethod
    def _final(op: str, n: int) -> Column:
        mean = F.coalesce(F.col("__s"), F.lit(0.0)) / F.lit(float(n))
        var = F.greatest(F.coalesce(F.col("__q"), F.lit(0.0)) / F.lit(float(n)) - mean * mean, F.lit(0.0))
        kept = {"max": "__max", "min": "__min", "count": "__n"}
        if op in kept:
            return F.coalesce(F.col(kept[op]).cast("double"), F.lit(0.0))
        return {"sum": F.coalesce(F.col("__s"), F.lit(0.0)), "mean": mean, "var": var, "std": F.sqrt(var)}[op]

    def reduce(self, *ops: str, axis: int | None) -> DataFrame:
        """Reductions in one pass: (id, *ops) over all selected ids of the axis, or one row for ``axis`` None.

        ``sum mean var std`` count absent pairs as zeros (var is that of the population); ``max min count`` look at
        stored entries only and are 0 where there is none.
        """
        if unknown := set(ops) - {"sum", "mean", "var", "std", "max", "min", "count"}:
            raise ValueError(f"no reduction {unknown}")
        if not min(self.shape):
            raise ValueError("an empty view can't be reduced")
        v, d, w = F.col(VALUE), self.df(), F.lit(1)
        # an id selected several times counts as often along the axis that is reduced
        for i, (sel, key) in enumerate(((self.rows, CELL), (self.cols, GENE))):
            if axis in (None, i) and (sel.span is None and sel.ids is None and sel.repeats() or sel.ids is not None and len(set(sel.ids)) < len(sel.ids)):
                times = sel.frame(self.source.sparkSession).groupBy(F.col("id").alias(f"__i{i}")).agg(F.count(F.lit(1)).alias(f"__w{i}"))
                d, w = d.join(times, d[key] == times[f"__i{i}"]), w * F.col(f"__w{i}")
        parts = [F.sum(v * w).alias("__s"), F.sum(v * v * w).alias("__q"), F.max(v).alias("__max"), F.min(v).alias("__min"), F.sum(w).alias("__n")]
        need = {"sum": "s", "mean": "s", "var": "sq", "std": "sq", "max": ["max"], "min": ["min"], "count": ["n"]}
        used = {f"__{x}" for o in ops for x in need[o]}
        parts = [p for p, k in zip(parts, ("__s", "__q", "__max", "__min", "__n")) if k in used]
        if axis is None:
            return d.agg(*parts).select(*(self._final(o, len(self.rows) * len(self.cols)).alias(o) for o in ops))
        key, sel, n = self._axis(axis)
        agg = d.groupBy(F.col(key).alias("__k")).agg(*parts)
        ids = sel.frame(self.source.sparkSession).select("id").distinct() if sel.span is None else sel.frame(self.source.sparkSession).select("id")
        return ids.join(agg, F.col("id") == F.col("__k"), "left").select(F.col("id").cast(self.source.schema[key].dataType).alias(key), *(self._final(o, n).alias(o) for o in ops))

    # reductions as arrays

    def _array(self, op: str, axis: int | None):
        r = self.reduce(op, axis=axis)
        if axis is None:
            return float(r.first()[op])
        key, sel, _ = self._axis(axis)
        got = r.toPandas().set_index(key)[op]
        out = got.reindex(sel.positions()).to_numpy(float)
        return out[None, :] if axis == 0 else out[:, None]

    def sum(self, axis: int | None = None):
        return self._array("sum", axis)

    def mean(self, axis: int | None = None):
        return self._array("mean", axis)

    def var(self, axis: int | None = None):
        return self._array("var", axis)

    def std(self, axis: int | None = None):
        return self._array("std", axis)

    def max(self, axis: int | None = None):
        return self._array("max", axis)

    def min(self, axis: int | None = None):
        return self._array("min", axis)

    def __array_function__(self, func, types, args, kwargs):
        name = {np.sum: "sum", np.mean: "mean", np.var: "var", np.std: "std", np.max: "max", np.min: "min"}.get(func)
        if name and isinstance(args[0], LazyMatrix):
            axis = kwargs.get("axis", args[1] if len(args) > 1 else None)
            return self._array(name, axis)
        return func(*(a.toarray() if isinstance(a, LazyMatrix) else a for a in args), **kwargs)

    # positions and materialisation

    def positions(self) -> DataFrame:
        """(row_pos, col_pos, value): entries by place in the selection; a repeated id gives its entries at each place."""
        spark = self.source.sparkSession
        r, c = self.rows.frame(spark).withColumnsRenamed({"pos": "row_pos", "id": "__r"}), self.cols.frame(spark).withColumnsRenamed({"pos": "col_pos", "id": "__c"})
        d = self.df()
        return d.join(r, d[CELL] == r["__r"]).join(c, d[GENE] == c["__c"]).select("row_pos", "col_pos", VALUE)

    def coo(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, row positions, column positions), ordered by row and column."""
        p = self.positions().toPandas().sort_values(["row_pos", "col_pos"])
        return p[VALUE].to_numpy(float), p.row_pos.to_numpy(), p.col_pos.to_numpy()

    def csr(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data, indices, indptr) of the compressed rows."""
        v, r, c = self.coo()
        return v, c, np.append(0, np.cumsum(np.bincount(r, minlength=len(self.rows))))

    def toarray(self) -> np.ndarray:
        if len(self.rows) * len(self.cols) > MAX_DENSE:
            raise ValueError(f"{self.shape} numbers are too many for the driver; use dense_rows()")
        out = np.zeros(self.shape)
        v, r, c = self.coo()
        out[r, c] = v
        return out

    compute = toarray

    def dense_rows(self) -> DataFrame:
        """(cell_integer_id, ``row`` array): one dense array per selected row; zero rows included."""
        spark = self.source.sparkSession
        at = self.cols.frame(spark).withColumnsRenamed({"pos": "__p", "id": "__c"})
        d = self.df()
        per = d.join(at, d[GENE] == at["__c"]).groupBy(F.col(CELL).alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct("__p", VALUE))).alias("__m"))
        places = F.sequence(F.lit(0).cast("bigint"), F.lit(len(self.cols) - 1).cast("bigint"))
        ids = self.rows.frame(spark).select("id").distinct()
        return ids.join(per, F.col("id") == F.col("__k"), "left").select(F.col("id").alias(CELL), F.transform(places, lambda p: F.coalesce(F.try_element_at("__m", p), F.lit(0.0))).alias("row"))
