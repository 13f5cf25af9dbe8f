"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: decay per second, rating bounds, weight per session action.
TIME_DECAY = 1e-6
RATING_BOUNDS = (1.0, 5.0)
ACTION_WEIGHTS = {0: 0.2, 1: 0.5, 2: 0.3}  # 0 click, 1 buy, 2 favourite
ITEM_KEY_PATTERN = r"ecommerce:product:(\d+)"


def guarded_reciprocal(x: Column) -> Column:
    """1/x, and 0 where x is 0: a factor that is absent does not count against the pair."""
    return F.when(x != 0, F.lit(1.0) / x).otherwise(F.lit(0.0))


def mfps_score(rc: Column, ru: Column, rd: Column, rt: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + sum((guarded_reciprocal(x) for x in (rc, ru, rd, rt)), F.lit(0.0)))


def time_closeness(t1: Column, t2: Column, alpha: float = TIME_DECAY) -> Column:
    return F.exp(F.lit(-alpha) * F.abs(t1 - t2))


def same_side(side1: Column, side2: Column, strict: bool = False) -> Column:
    """1 when both ratings lie on the same side of their user's mean (side is -1, 0 or 1)."""
    product = side1 * side2
    return F.when(product > 0 if strict else product >= 0, 1).otherwise(0)


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    if high is not None:
        x = F.least(x, F.lit(float(high)))
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    return x


def squared_error(predicted: Column, actual: Column) -> Column:
    return F.pow(predicted - actual, F.lit(2.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    """Dense Euclidean distance; null when the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; null for a zero vector."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))


def action_weight(action: Column) -> Column:
    """Weight of a session action; null for actions that do not count."""
    weight = F.lit(None).cast("double")
    for code, value in ACTION_WEIGHTS.items():
        weight = F.when(action == code, F.lit(value)).otherwise(weight)
    return weight


def item_id_from_key(key: Column) -> Column:
    """The id in a stored document key, null when the key is of another kind."""
    return F.nullif(F.regexp_extract(key, ITEM_KEY_PATTERN, 1), F.lit("")).cast("bigint")


def epoch_seconds(ts_ntz: Column) -> Column:
    """Epoch seconds of a zone-less timestamp read as UTC, whatever the session zone is."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts_ntz)


def epoch_micros(ts_ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts_ntz)


def round_to(x: Column, places: int) -> Column:
    """Round half away from zero in double arithmetic (the built-in goes through decimals, far slower)."""
    scale = F.lit(10.0 ** places)
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)).cast("double") / scale
