"""The n smallest rows of a large relation, without sorting it or pulling them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most this many rows are ever sorted in one place.
SORTED_ROWS = 100_000


def nth_smallest(df: DataFrame, value: str, tie: str, n: int, sorted_rows: int = SORTED_ROWS):
    """(value, tie) of the n-th row in the order (value, tie), or None if there are fewer rows.

    Approximate quantiles close in on the n-th value, exact counts keep track of its rank, and
    only a small remainder is sorted. `tie` must be unique among equal values.
    """
    total = df.count()
    if n > total:
        return None
    left, rank, rows = df.select(value, tie), n, total
    by = value

    def keep(condition, skipped, count):
        nonlocal left, rank, rows
        left, rank, rows = left.where(condition), rank - skipped, count

    while rows > sorted_rows:
        step = max(rows // 100, sorted_rows // 4) / rows
        ends = [max(0.0, (rank - 1) / rows - step), min(1.0, rank / rows + step)]
        low, high = left.agg(F.percentile_approx(by, ends, 1000).alias("ends")).first()["ends"]
        x = F.col(by)
        count = lambda condition: F.count(F.when(condition, 1))
        below, equal, inside = left.agg(count(x < low), count(x == low), count(x.between(low, high))).first()
        if rank <= below:  # the estimate missed: look below or above it
            keep(x < low, 0, below)
        elif rank > below + inside:
            keep(x > high, below + inside, rows - below - inside)
        elif rank <= below + equal and (low == high or inside == rows):
            keep(x == low, below, equal)  # a large group of equal values: the tie column decides
            by = tie
        elif inside == rows:
            keep(x > low, equal, rows - equal)
        else:
            keep(x.between(low, high), below, inside)
    last = left.orderBy(value, tie).limit(rank).agg(F.max(F.struct(value, tie)).alias("x")).first()["x"]
    return last[value], last[tie]


def up_to(value: str, tie: str, cutoff) -> Column:
    """Whether a row is among the n smallest, given nth_smallest's answer."""
    if cutoff is None:
        return F.lit(True)
    last, last_tie = cutoff
    return (F.col(value) < F.lit(last)) | ((F.col(value) == F.lit(last)) & (F.col(tie) <= F.lit(last_tie)))
