"""Names of columns that an operator adds."""

from __future__ import annotations

from pyspark.sql import DataFrame


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its own columns of these names (in any case), which the operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in taken))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no column of it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
