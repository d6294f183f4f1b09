"""Column expressions on token sequences (arrays)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(tokens: Column | str, size: Column | int, pad: int) -> Column:
    """Tokens, filled up to ``size`` with ``pad`` on the right."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    size = F.lit(size) if isinstance(size, int) else size
    missing = F.greatest(size.cast("int") - F.size(tokens), F.lit(0))
    return F.concat(tokens, F.array_repeat(F.lit(pad).cast("int"), missing))


def shifted_right(tokens: Column | str) -> Column:
    """The last token (the end mark) moved to the front: a decoder's input for the sequence."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    n = F.size(tokens)
    return F.when(n > 0, F.concat(F.slice(tokens, -1, 1), F.slice(tokens, F.lit(1), n - 1))).otherwise(tokens)


def without_prefix(tokens: Column | str, size: int) -> Column:
    """Tokens without their first ``size``."""
    if size < 0:
        raise ValueError("the prefix size must not be negative")
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.slice(tokens, F.lit(size + 1), F.greatest(F.size(tokens) - size, F.lit(0)))


def interval(begin: Column | str, end: Column | str) -> Column:
    """begin .. end - 1, empty where end is not above begin (``sequence`` alone would count down)."""
    begin, end = (F.col(c) if isinstance(c, str) else c for c in (begin, end))
    return F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))


def trace(label: Column | str, ids: Column | str) -> Column:
    """``R-<label><TAB><ids>``, the ids joined by blanks."""
    label, ids = (F.col(c) if isinstance(c, str) else c for c in (label, ids))
    return F.concat(F.lit("R-"), label.cast("string"), F.lit("\t"), F.array_join(F.transform(ids, lambda x: x.cast("string")), " "))
