"""From the coordinate table to training batches: window, tokens, order, batches."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers
from ..functions import tokens as tk
from . import windows
from .shuffle import random_order, stratified_order


OWN_KINDS = ("geneformer", "scgpt")  # padding stands at the end only, and the mask follows from it
KINDS = {"length": np.int32, "width": np.int32, "input_ids": np.int64, "attention_mask": np.bool_, "values": np.int64}


@dataclass(frozen=True)
class BatchPlan:
    """What a loader yields. ``kind``: "geneformer" (items by rank), "scgpt" (items and value bins), "raw", or a registered tokenizer."""

    kind: str = "geneformer"
    batch_size: int = 32
    max_items: int = 2048
    vocab_size: int = 50_000
    bins: int = 10
    n_epochs: int = 1
    seed: int = 42
    min_percentile: float | None = None
    stratum: str | None = None

    def __post_init__(self):
        if self.kind != "raw" and self.kind not in windows.TOKENIZERS:
            raise ValueError(f"no kind {self.kind!r}")
        if self.batch_size < 1 or self.n_epochs < 1:
            raise ValueError("batch_size and n_epochs must be at least 1")


def token_table(expression: DataFrame, plan: BatchPlan) -> DataFrame:
    """One row per group: cell_integer_id, ``input_ids`` and ``attention_mask``, ``values`` (scgpt), or items and values (raw)."""
    if plan.kind == "raw":
        return windows.group_lists(expression)
    options = {"max_items": plan.max_items, "vocab_size": plan.vocab_size}
    if plan.kind == "geneformer":
        options |= {"length": plan.max_items, "min_percentile": plan.min_percentile, "order": "rank"}
    elif plan.kind == "scgpt":
        options |= {"bins": plan.bins}
    return windows.tokenizer(plan.kind, **options)(expression)


def placed_ids(expression: DataFrame, plan: BatchPlan, cells: DataFrame | None = None, epoch: int = 0) -> DataFrame:
    """(cell_integer_id, ``place``, ``batch``) of one epoch."""
    ids = expression.select("cell_integer_id").distinct()
    seed = plan.seed + 10_000 * epoch
    if plan.stratum and cells is not None:
        placed = stratified_order(ids.join(cells.select("cell_integer_id", plan.stratum), "cell_integer_id", "left"), "cell_integer_id", plan.stratum, seed).select("cell_integer_id", "place")
    else:
        placed = random_order(ids, "cell_integer_id", seed)
    return placed.withColumn("batch", F.floor(F.col("place") / plan.batch_size).cast("bigint"))


def batched(expression: DataFrame, plan: BatchPlan, cells: DataFrame | None = None, epoch: int = 0) -> DataFrame:
    """Tokens with ``place`` and ``batch`` for one epoch; orders ids first, so the wide arrays are joined, not sorted."""
    return token_table(expression, plan).join(placed_ids(expression, plan, cells, epoch), "cell_integer_id")


def without_padding(tokens: DataFrame) -> DataFrame:
    """Tokens cut before their padding, with ``length`` and the padded ``width`` instead of the mask; :func:`padded` undoes it."""
    t = tokens.drop("attention_mask").withColumns({"length": tk.token_count(F.col("input_ids")).cast("int"), "width": F.size("input_ids")})
    return t.withColumns({c: F.slice(c, F.lit(1), F.col("length")) for c in ("input_ids", "values") if c in t.columns})


def padded(length: np.ndarray, width: np.ndarray, flat: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``flat``: the tokens of a batch's rows one after another -> arrays of ``width``, and the mask behind ``input_ids``."""
    mask = np.arange(width.max(initial=0)) < length[:, None]
    out = {}
    for c, x in flat.items():
        out[c] = np.full(mask.shape, tk.PAD, x.dtype)
        out[c][mask] = x
        if c == "input_ids":
            out["attention_mask"] = mask
    return out


def _packed(columns: list[str]):
    """Rows sorted by place -> one row per batch, every column as the bytes of one array."""

    def run(parts: Iterable) -> Iterator:
        import pyarrow as pa

        held = None
        for part in itertools.chain(parts, [None]):
            table = pa.Table.from_batches([b for b in (held, part) if b is not None]).combine_chunks() if held is not None or part is not None else None
            if table is None or not table.num_rows:
                continue
            ids = table.column("batch").to_numpy()
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            ends = np.append(starts[1:], len(ids))
            if part is not None:  # the last batch may go on
                held = table.slice(starts[-1]).to_batches()[0]
                starts, ends = starts[:-1], ends[:-1]
            out = {"batch": pa.array(ids[starts]), "n": pa.array(ends - starts, pa.int32())}
            for c in columns:
                col = table.column(c).combine_chunks()
                col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
                cut = [col.slice(a, b - a) for a, b in zip(starts, ends)]
                flat = [x.flatten() if pa.types.is_list(x.type) else x for x in cut]
                out[c] = pa.array([f.to_numpy(zero_copy_only=False).tobytes() for f in flat], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


class BatchLoader:
    """Iterates over batches as dicts of arrays.

    The executors stack each batch into arrays; the driver gets one row of bytes per batch, partition by partition, the
    next partition being fetched meanwhile. Padding of the own kinds is neither shuffled nor sent, but added at the end;
    registered tokenizers may pad and mask as they like, so theirs travels. ``metrics`` tells batches, rows, tokens and seconds waited so far.
    """

    def __init__(self, expression: DataFrame, plan: BatchPlan = BatchPlan(), cells: DataFrame | None = None):
        self.expression, self.plan, self.cells = expression, plan, cells
        self.metrics = {"batches": 0, "rows": 0, "tokens": 0, "seconds": 0.0, "rows_per_second": 0.0}

    def __iter__(self) -> Iterator[dict]:
        return self._raw() if self.plan.kind == "raw" else self._arrays()

    def _count(self, batch: dict, began: float) -> dict:
        m = self.metrics
        m["batches"] += 1
        m["rows"] += len(batch["cell_ids"])
        m["tokens"] += int(batch["attention_mask"].sum()) if "attention_mask" in batch else 0
        m["seconds"] += time.monotonic() - began
        m["rows_per_second"] = m["rows"] / m["seconds"] if m["seconds"] else 0.0
        return batch

    def packed(self, epoch: int = 0) -> DataFrame:
        """(batch, n, and of every column the bytes of its array), one row per batch of arrays."""
        tokens = token_table(self.expression, self.plan)
        if self.plan.kind in OWN_KINDS:
            tokens = without_padding(tokens)
        rows = tokens.join(placed_ids(self.expression, self.plan, self.cells, epoch), "cell_integer_id")
        columns = ["cell_integer_id", *(c for c in KINDS if c in rows.columns)]
        exact = [F.col(c).cast("array<bigint>").alias(c) if c in ("input_ids", "values") else F.col(c) for c in columns]
        workers(rows.sparkSession)
        placed = rows.select("batch", "place", *exact).repartitionByRange("batch").sortWithinPartitions("place").drop("place")
        return placed.mapInArrow(_packed(columns), "batch bigint, n int, " + ", ".join(f"{c} binary" for c in columns))

    def _arrays(self) -> Iterator[dict]:
        for epoch in range(self.plan.n_epochs):
            packed = self.packed(epoch)
            began = time.monotonic()
            for r in packed.toLocalIterator(prefetchPartitions=True):
                a = {c: np.frombuffer(r[c], KINDS.get(c, np.int64)) for c in packed.columns[2:]}
                ids = a.pop("cell_integer_id")
                arrays = padded(a.pop("length"), a.pop("width"), a) if "length" in a else {c: x.reshape(r["n"], -1) for c, x in a.items()}
                batch = {"cell_ids": ids, "epoch": epoch, **arrays}
                yield self._count(batch, began)
                began = time.monotonic()

    def _raw(self) -> Iterator[dict]:
        """Batches of item and value lists, whose lengths differ."""
        for epoch in range(self.plan.n_epochs):
            lists = F.sort_array(F.collect_list(F.struct("place", "cell_integer_id", "gene_sequence", "expr_sequence")))
            rows = batched(self.expression, self.plan, self.cells, epoch).groupBy("batch").agg(lists.alias("x")).orderBy("batch")
            began = time.monotonic()
            for r in rows.toLocalIterator(prefetchPartitions=True):
                yield self._count({"cell_ids": np.array([x["cell_integer_id"] for x in r["x"]]), "epoch": epoch, "x": [(x["gene_sequence"], x["expr_sequence"]) for x in r["x"]]}, began)
                began = time.monotonic()
