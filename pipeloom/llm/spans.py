"""Typed spans over texts: their Spark type and digests of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places are code points, end exclusive.
SPANS = "array<struct<kind:string,start:long,end:long,text:string>>"


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of spans (of these kinds), comma-joined in their order; spans are ordered by start, then kind."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
