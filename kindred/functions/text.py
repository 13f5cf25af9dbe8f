"""Text to terms and hashed term weights, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_slot(term: Column, dims: int) -> Column:
    """Stable position of a term in a vector of the given length (leading 32 bits of its md5)."""
    return F.pmod(F.conv(F.substring(F.md5(F.encode(term, "UTF-8")), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int")
