"""Selector algebra: NumPy-style keys over one axis, compiled to predicates or semi-joins."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_rank

MAX_IN_LIST = 1000  # longer id lists become a semi-join
MAX_COLLECTED = 50_000_000  # ids that an array on the driver may have


@dataclass(frozen=True)
class Selector:
    """Positions 0..n-1 of an axis: a ``range``, or ids in the order asked for (repeats allowed)."""

    n: int
    span: range | None = None
    ids: tuple[int, ...] | None = None

    def __len__(self) -> int:
        return len(self.span) if self.span is not None else len(self.ids)

    def positions(self) -> np.ndarray:
        """The selected ids in order."""
        return np.arange(self.span.start, self.span.stop, self.span.step) if self.span is not None else np.asarray(self.ids, np.int64)

    @property
    def is_all(self) -> bool:
        return self.span == range(self.n)

    def predicate(self, column: str) -> Column | None:
        """A condition on the id column that reaches the scan, or None where a semi-join is needed."""
        c = F.col(column)
        if self.span is not None:
            r = self.span if self.span.step > 0 else self.span[::-1]
            if not len(r):
                return F.lit(False)
            if self.is_all:
                return F.lit(True)
            cond = (c >= r.start) & (c < r.stop)
            return cond if r.step == 1 else cond & ((c - r.start) % r.step == 0)
        distinct = sorted(set(self.ids))
        if not distinct:
            return F.lit(False)
        if is_consecutive(distinct):
            return c.between(distinct[0], distinct[-1])
        return c.isin(distinct) if len(distinct) <= MAX_IN_LIST else None

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of ``df`` whose id is selected."""
        p = self.predicate(column)
        if p is not None:
            return df if self.is_all else df.filter(p)
        ids = df.sparkSession.createDataFrame([(int(i),) for i in sorted(set(self.ids))], "__sq_id bigint")
        return df.join(ids, df[column] == ids["__sq_id"], "left_semi")

    def frame(self, spark) -> DataFrame:
        """(pos, id): one row per place in the selection, repeats included."""
        if self.span is not None:
            r = self.span
            return spark.range(len(r)).select(F.col("id").alias("pos"), (F.lit(r.start) + F.col("id") * r.step).alias("id"))
        return spark.createDataFrame([(i, int(x)) for i, x in enumerate(self.ids)], "pos bigint, id bigint")


class TableSelector:
    """The ids of a table in ascending order, each once: a selection whose ids never come to the driver.

    ``table``: (pos, id) of the selection. Slices compose by position; only :meth:`positions` collects.
    """

    span = None
    ids = None
    is_all = False

    def __init__(self, n: int, table: DataFrame, repeats: bool = False):
        self.n, self.table, self._size, self._repeats = n, table, None, repeats

    @classmethod
    def of(cls, n: int, ids: DataFrame) -> TableSelector:
        """From a one-column table of ids."""
        one = ids.select(F.col(ids.columns[0]).cast("bigint").alias("id")).filter("id is not null").distinct()
        return cls(n, global_rank(one, [F.col("id")], "pos").select("pos", "id"))

    def __len__(self) -> int:
        if self._size is None:
            self._size = self.table.count()
        return self._size

    def positions(self) -> np.ndarray:
        """The selected ids in order, on the driver; arrays are asked for this way, plans are not."""
        if len(self) > MAX_COLLECTED:
            raise ValueError(f"{len(self)} ids are too many for the driver")
        return self.table.orderBy("pos").select("id").toPandas()["id"].to_numpy(np.int64)

    def predicate(self, column: str) -> Column | None:
        return None

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        ids = self.table.select(F.col("id").alias("__sq_id"))
        return df.join(ids, df[column] == ids["__sq_id"], "left_semi")

    def frame(self, spark) -> DataFrame:
        return self.table

    def repeats(self) -> bool:
        """Whether an id is selected more than once."""
        return self._repeats

    def part(self, inner: Selector) -> TableSelector:
        """What ``inner`` selects of the places of this selection."""
        if inner.span is not None and inner.span.step > 0:
            r = inner.span
            keep = self.table.filter(inner.predicate("pos")).select(F.floor((F.col("pos") - r.start) / r.step).cast("bigint").alias("pos"), "id") if len(r) else self.table.limit(0)
            return TableSelector(self.n, keep, self._repeats)
        at = inner.frame(self.table.sparkSession).withColumnsRenamed({"pos": "__p", "id": "__at"})
        return TableSelector(self.n, at.join(self.table, F.col("__at") == F.col("pos")).select(F.col("__p").alias("pos"), "id"), self._repeats or inner.ids is not None and len(set(inner.ids)) < len(inner.ids))


def normalize(key: Any, n: int) -> Selector | TableSelector:
    """Selector for a NumPy-style key: None, slice, range, int, list of ints, a mask of length ``n``, or a table of ids.

    An id outside -n..n-1 raises IndexError, a mask of another length and a step of 0 raise ValueError.
    """
    if isinstance(key, (Selector, TableSelector)):
        return key
    if isinstance(key, DataFrame):
        return TableSelector.of(n, key)
    if key is None or key is Ellipsis:
        return Selector(n, range(n))
    if isinstance(key, slice):
        if key.step == 0:
            raise ValueError("a slice step can't be zero")
        return Selector(n, range(*key.indices(n)))
    if isinstance(key, range):
        return normalize(list(key), n)
    if isinstance(key, (bool, np.bool_)):
        raise TypeError("a single truth value is no selector")
    if isinstance(key, (int, np.integer)):
        return Selector(n, ids=(_place(int(key), n),))
    a = np.asarray(key)
    if a.ndim > 1 and a.size == max(a.shape):
        a = a.ravel()  # as given by np.ix_
    if a.dtype == bool:
        if len(a) != n:
            raise ValueError(f"a mask of length {len(a)} can't select from {n}")
        return Selector(n, ids=tuple(int(i) for i in np.flatnonzero(a)))
    if a.size and a.dtype.kind not in "iu":
        raise TypeError(f"can't select with {a.dtype} values")
    return Selector(n, ids=tuple(_place(int(i), n) for i in a))


def _place(i: int, n: int) -> int:
    if not -n <= i < n:
        raise IndexError(f"{i} is out of range for {n}")
    return i + n if i < 0 else i


def compose(first: Selector, key: Any) -> Selector:
    """``key`` applied to what ``first`` has selected."""
    inner = normalize(key, len(first))
    if isinstance(first, TableSelector):
        return first.part(inner)
    if isinstance(inner, TableSelector):  # ids of a table are ids of the axis, whatever is selected
        return TableSelector.of(first.n, first.apply(inner.table, "id").select("id"))
    if first.span is not None and inner.span is not None:
        return Selector(first.n, first.span[inner.span.start : inner.span.stop : inner.span.step] if len(inner.span) and inner.span.step > 0 else _pick(first.span, inner.span))
    chosen = first.positions()[inner.positions()] if len(inner) else []
    return Selector(first.n, ids=tuple(int(i) for i in chosen))


def _pick(outer: range, inner: range) -> range:
    if not len(inner):
        return range(0)
    a, step = outer[inner[0]], outer.step * inner.step
    return range(a, a + step * len(inner), step)


def parse_key(key: Any) -> tuple[Any, Any]:
    """Row and column part of ``x[key]``; more than two parts raise IndexError."""
    if not isinstance(key, tuple):
        return key, None
    if len(key) > 2:
        raise IndexError(f"a matrix has two axes, not {len(key)}")
    return key[0], key[1] if len(key) == 2 else None


def is_consecutive(ids: list[int]) -> bool:
    """Whether sorted distinct ids have no gap."""
    return not ids or ids[-1] - ids[0] + 1 == len(ids)


def id_batches(ids: list[int], max_gap: int = 10, max_size: int = 100) -> list[list[int]]:
    """Sorted ids in batches that break at gaps above ``max_gap`` and at ``max_size`` ids."""
    out: list[list[int]] = []
    for i in sorted(ids):
        if not out or i - out[-1][-1] > max_gap or len(out[-1]) >= max_size:
            out.append([])
        out[-1].append(i)
    return out


def strategy(ids: list[int]) -> str:
    """How an id set is looked up: empty, single, consecutive, in list, or semi-join."""
    d = sorted(set(ids))
    if len(d) < 2:
        return "single" if d else "empty"
    return "consecutive" if is_consecutive(d) else "in list" if len(d) <= MAX_IN_LIST else "semi-join"
