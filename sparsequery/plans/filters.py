"""The metadata filter language: keyword conditions that are all to hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest sign first, so that ">=" isn't read as ">".
SIGNS = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__}


def condition(df: DataFrame, name: str, wanted) -> Column:
    """A string that begins with a sign compares numbers; a list means any of; anything else equality.

    Unknown columns, signs on a column that holds no numbers and text that is no number raise ValueError at once.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if name not in kinds:
        raise ValueError(f"no column {name!r}; there are {', '.join(kinds)}")
    c, numeric = F.col(f"`{name}`"), isinstance(kinds[name], T.NumericType)
    if isinstance(wanted, str):
        for sign, op in SIGNS.items():
            if wanted.startswith(sign):
                if not numeric:
                    raise ValueError(f"{name!r} holds no numbers to compare with {wanted!r}")
                try:
                    return op(c, F.lit(float(wanted[len(sign) :])))
                except ValueError:
                    raise ValueError(f"{wanted!r} has no number behind the sign") from None
        if numeric:
            raise ValueError(f"{name!r} holds numbers, not {wanted!r}")
    if isinstance(wanted, (list, tuple, set)):
        return c.isin(list(wanted))
    return c.isNull() if wanted is None else c == F.lit(wanted)


def where(df: DataFrame, **conditions) -> DataFrame:
    """Rows that meet all conditions; without any, all rows."""
    parts = [condition(df, k, v) for k, v in conditions.items()]
    return df.filter(reduce(Column.__and__, parts)) if parts else df
