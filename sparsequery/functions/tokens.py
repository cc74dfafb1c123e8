"""Token sequences from item lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids of the special tokens, and what is added to an item id.
PAD, CLS, SEP, MASK, OFFSET = 0, 1, 2, 3, 4


def item_tokens(items: Column, vocab_size: int) -> Column:
    """Item ids shifted past the special tokens; items that would leave the vocabulary are dropped."""
    return F.transform(F.filter(items, lambda x: x < vocab_size - OFFSET), lambda x: (x + OFFSET).cast("bigint"))


def _fixed(a: Column, n: int) -> Column:
    """Cut to ``n`` and filled up with padding; only what is missing is made."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(PAD).cast("bigint"), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def _one(x: int) -> Column:
    return F.array(F.lit(x).cast("bigint"))


def rank_tokens(items: Column, vocab_size: int = 50_000, length: int = 2048) -> Column:
    """[CLS] items [SEP], cut and then padded to ``length``; the closing token can be cut."""
    return _fixed(F.concat(_one(CLS), item_tokens(items, vocab_size), _one(SEP)), length)


def token_count(ids: Column) -> Column:
    """How many tokens come before the padding, which stands at the end only."""
    first = F.array_position(ids, F.lit(PAD).cast("bigint")).cast("int")
    return F.when(first == 0, F.size(ids)).otherwise(first - 1)


def attention_mask(ids: Column) -> Column:
    """True for every token before the padding."""
    n = token_count(ids)
    return F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.size(ids) - n))


def bin_token(value: Column, bins: int = 10, vocab_size: int = 50_000) -> Column:
    """Token of a value in 0..1: PAD where it is not above 0, else its bin behind the vocabulary."""
    b = F.least(F.floor(value * F.lit(float(bins))), F.lit(bins - 1)) + vocab_size
    return F.when(value > 0, b).otherwise(PAD).cast("bigint")


def value_tokens(items: Column, values: Column, vocab_size: int = 50_000, max_items: int = 1024, bins: int = 10, binned: bool = True) -> tuple[Column, Column]:
    """(ids, values), both ``max_items`` + 2 long: items as in :func:`rank_tokens`, and each item's value token.

    ``binned`` values are whole bin numbers and only shifted; others go through :func:`bin_token`.
    """
    pairs = F.slice(F.filter(F.arrays_zip(items.alias("i"), values.alias("v")), lambda p: p["i"].isNotNull() & p["v"].isNotNull() & (p["i"] < vocab_size - OFFSET)), 1, max_items)
    ids = _fixed(F.concat(_one(CLS), F.transform(pairs, lambda p: (p["i"] + OFFSET).cast("bigint")), _one(SEP)), max_items + 2)
    tok = (lambda p: (p["v"] + vocab_size).cast("bigint")) if binned else (lambda p: bin_token(p["v"], bins, vocab_size))
    return ids, _fixed(F.concat(_one(PAD), F.transform(pairs, tok), _one(PAD)), max_items + 2)


def vocabulary(genes: DataFrame, vocab_size: int = 50_000) -> DataFrame:
    """(token, gene_integer_id, gene_id) of the items that fit."""
    return genes.filter(F.col("gene_integer_id") < vocab_size - OFFSET).select((F.col("gene_integer_id") + OFFSET).cast("bigint").alias("token"), "gene_integer_id", "gene_id")


def decode(tokens: DataFrame, column: str, vocab: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, pos, token, gene_id, special): one row per token, in place; padding is left out."""
    t = tokens.select(*keep, F.posexplode(column).alias("pos", "__t")).filter(F.col("__t") != PAD)
    name = F.when(F.col("__t") == CLS, "CLS").when(F.col("__t") == SEP, "SEP").when(F.col("__t") == MASK, "MASK")
    v = vocab.select("token", "gene_id")
    return t.join(v, t["__t"] == v["token"], "left").select(*keep, "pos", F.col("__t").alias("token"), "gene_id", name.alias("special"))
