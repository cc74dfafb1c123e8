"""Per-group ranking, top-k and list aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tokens as tk


@dataclass(frozen=True)
class GroupSpec:
    """Which columns hold the group, the item and the value, and how the lists are called."""

    group: str = "cell_integer_id"
    item: str = "gene_integer_id"
    value: str = "value"
    items: str = "gene_sequence"
    values: str = "expr_sequence"


def group_lists(df: DataFrame, spec: GroupSpec = GroupSpec(), values: bool = True, order: str = "item", value: Column | None = None) -> DataFrame:
    """(group, items[, values]): lists by item id, or by value descending then item with ``order`` "rank"."""
    v = F.col(spec.value) if value is None else value
    first = (-F.col(spec.value)) if order == "rank" else F.lit(0)
    entry = F.struct(first.alias("o"), F.col(spec.item).alias("i"), v.alias("v"))
    a = df.groupBy(spec.group).agg(F.array_sort(F.collect_list(entry)).alias("__l"))
    cols = [F.col(spec.group), F.transform("__l", lambda x: x["i"]).alias(spec.items)]
    return a.select(*cols, F.transform("__l", lambda x: x["v"]).alias(spec.values)) if values else a.select(*cols)


def top_ranked(df: DataFrame, max_items: int, spec: GroupSpec = GroupSpec(), strict: bool = False, min_percentile: float | None = None) -> DataFrame:
    """Rows whose dense rank by value descending is at most ``max_items``: ties are kept, so a group may exceed it.

    ``strict`` keeps exactly the first ``max_items`` (ties by item). ``min_percentile`` p also asks for an ascending
    dense rank of at least p % of the group's highest.
    """
    down = Window.partitionBy(spec.group).orderBy(F.desc(spec.value))
    if min_percentile is not None:
        up = Window.partitionBy(spec.group).orderBy(spec.value)
        df = df.withColumn("__a", F.dense_rank().over(up))
        df = df.withColumn("__d", F.dense_rank().over(down)).withColumn("__m", F.max("__a").over(Window.partitionBy(spec.group)))
        return df.filter((F.col("__d") <= max_items) & (F.col("__a") >= F.lit(min_percentile / 100.0) * F.col("__m"))).drop("__a", "__d", "__m")
    rank = F.row_number().over(Window.partitionBy(spec.group).orderBy(F.desc(spec.value), spec.item)) if strict else F.dense_rank().over(down)
    return df.withColumn("__d", rank).filter(F.col("__d") <= max_items).drop("__d")


def generic_window(df, max_items, spec: GroupSpec = GroupSpec(), values=True, strict=False, order="item") -> DataFrame:
    """Lists of the top items of every group, with values."""
    return group_lists(top_ranked(df, max_items, spec, strict), spec, values, order)


simple_window = generic_window


def item_window(df, max_items, spec: GroupSpec = GroupSpec(), min_percentile=None, order="item") -> DataFrame:
    """Lists of items without values, optionally above a percentile of the group's ranks."""
    return group_lists(top_ranked(df, max_items, spec, min_percentile=min_percentile), spec, False, order)


def value_bins(df: DataFrame, bins: int, spec: GroupSpec = GroupSpec()) -> DataFrame:
    """``__bin``: floor of log1p(value) * bins / the group's largest, within 0..bins-1; 0 for values not above 0."""
    lv = F.log1p(F.col(spec.value).cast("double"))
    top = F.max(lv).over(Window.partitionBy(spec.group))
    raw = F.floor(F.round(F.try_divide(lv * bins, top), 9))
    return df.withColumn("__bin", F.when(F.col(spec.value) > 0, F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).otherwise(0).cast("int"))


def binned_window(df, max_items, bins=10, spec: GroupSpec = GroupSpec(), use_bins=True, order="item") -> DataFrame:
    """Lists of items and value bins (``use_bins``) or raw values."""
    if not use_bins:
        return generic_window(df, max_items, spec, order=order)
    kept = top_ranked(value_bins(df, bins, spec), max_items, spec)
    return group_lists(kept, spec, True, order, F.col("__bin"))


WINDOWS = {"generic": generic_window, "simple": simple_window, "geneformer": item_window, "scgpt": binned_window}


def create_window(name: str):
    """A window by name; an unknown name raises ValueError."""
    if name not in WINDOWS:
        raise ValueError(f"no window {name!r}; there are {', '.join(WINDOWS)}")
    return WINDOWS[name]


# tokenizers over grouped tables


class Tokenizer(Protocol):
    """What a tokenizer is: a function from a coordinate table to one row per group with ``input_ids`` and ``attention_mask``."""

    def __call__(self, expression: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RankTokenizer:
    """Items as a rank sequence: [CLS] items [SEP], padded to ``length``. ``order`` "rank" puts the highest value first."""

    max_items: int = 2048
    length: int = 2048
    vocab_size: int = 50_000
    min_percentile: float | None = None
    order: str = "item"
    spec: GroupSpec = GroupSpec()

    def __call__(self, expression: DataFrame) -> DataFrame:
        g = item_window(expression, self.max_items, self.spec, self.min_percentile, self.order)
        t = g.select(self.spec.group, tk.rank_tokens(F.col(self.spec.items), self.vocab_size, self.length).alias("input_ids"))
        return t.withColumn("attention_mask", tk.attention_mask(F.col("input_ids")))


@dataclass(frozen=True)
class ValueTokenizer:
    """Items and, beside each, the token of its value's bin, in two sequences of ``max_items`` + 2."""

    max_items: int = 2048
    vocab_size: int = 50_000
    bins: int = 10
    spec: GroupSpec = GroupSpec()

    def __call__(self, expression: DataFrame) -> DataFrame:
        g = binned_window(expression, self.max_items, self.bins, self.spec)
        ids, vals = tk.value_tokens(F.col(self.spec.items), F.col(self.spec.values), self.vocab_size, self.max_items, self.bins)
        return g.select(self.spec.group, ids.alias("input_ids"), vals.alias("values")).withColumn("attention_mask", tk.attention_mask(F.col("input_ids")))


TOKENIZERS: dict[str, Callable[..., Tokenizer]] = {"geneformer": RankTokenizer, "scgpt": ValueTokenizer}


def register_tokenizer(name: str, make: Callable[..., Tokenizer]) -> None:
    """Make ``tokenizer(name, ...)`` call ``make(...)``; a name that is taken raises ValueError."""
    if name in TOKENIZERS:
        raise ValueError(f"there is a tokenizer {name!r} already")
    TOKENIZERS[name] = make


def tokenizer(name: str, **options) -> Tokenizer:
    """A tokenizer by name; an unknown name raises ValueError."""
    if name not in TOKENIZERS:
        raise ValueError(f"no tokenizer {name!r}; there are {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name](**options)


# groups over fragments


def islands(ids: DataFrame, key: str, by: str) -> DataFrame:
    """(by, ``first``, ``last``, ``n``): runs of consecutive ids inside each value of ``by``."""
    run = F.col(key) - F.row_number().over(Window.partitionBy(by).orderBy(key))
    return ids.select(key, by).distinct().withColumn("__k", run).groupBy(by, "__k").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).drop("__k")


def distinct_pairs(df: DataFrame, spec: GroupSpec = GroupSpec()) -> DataFrame:
    """The (group, item) pairs that occur, each once."""
    return df.select(spec.group, spec.item).distinct()


def split_groups(df: DataFrame, group: str, fragment: str) -> DataFrame:
    """(group, ``n_parts``) of the groups whose rows lie in more than one fragment."""
    return df.groupBy(group).agg(F.countDistinct(fragment).alias("n_parts")).filter("n_parts > 1")


def completeness(rows: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """(group, expected, ``observed``, ``complete``): rows present of those that ``expected`` (group, expected) announces."""
    n = rows.groupBy(F.col(group).alias("__k")).agg(F.count(F.lit(1)).alias("observed"))
    j = expected.join(n, F.col(group) == F.col("__k"), "left").select(group, "expected", F.coalesce("observed", F.lit(0)).cast("bigint").alias("observed"))
    return j.withColumn("complete", F.col("observed") >= F.col("expected"))
