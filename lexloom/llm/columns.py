"""Column helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, so that further columns never clash; a null text counts as empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: the optimizer would else copy it to each place of use, into loops too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(arr: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes, from 0 on, of the numbers before each of a BIGINT array, and of all: n + 1 numbers.

    Runs in chunks of 256, so that growing the result stays cheap for arrays with very many entries.
    """
    zero = F.lit(0).cast("bigint")
    grow = lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / 256).cast("int")), lambda i: F.slice(a, i * 256 + 1, 256))
    begun = lambda chunks: F.aggregate(chunks, F.array(zero), lambda acc, c: grow(acc, F.aggregate(c, zero, join)))
    inner = lambda chunks, b: F.transform(chunks, lambda c, i: F.slice(F.aggregate(c, F.array(F.get(b, i)), grow), 1, F.size(c)))
    return let(arr, lambda a: let(cut(a), lambda chunks: let(begun(chunks), lambda b: F.concat(F.flatten(inner(chunks, b)), F.array(F.element_at(b, -1))))))


def span_digest(spans: Column) -> Column:
    """Lowercase hex SHA-256 of the span list in text form."""
    return F.sha2(span_text(spans), 256)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
