"""Joining the raters of each item with one another, evenly spread.

Pairs of users that rated the same item are what the similarity is made of. An item rated by a
large share of all users would put the square of that share into one task of a plain item join.
Users are therefore hashed into blocks, and a pair is met only in the cell (low, high) of its two
blocks; a rating is copied into the cells of its block. Three ways to choose the blocks:

* join: an item gets ceil(raters / CHUNK) blocks of its own, so an ordinary item has one cell and
  is not copied, and no cell holds more than about CHUNK raters a side. Pair rows are then
  aggregated by (u, v), which shuffles them (after a partial aggregate).
* lists: the raters of an item are gathered in lists of at most about CHUNK; each rating meets the lists of its item and moves, once
  per list, to its user with those raters in it that have a larger id, their integers as one number in columns as narrow as its bits
  allow. All rows of a pair are then with its smaller user, so the aggregation moves nothing more. A user
  with very many meetings is cut into parts by the other user.
* grid: all items share the same blocks and the data is partitioned by cell. All rows of a pair
  are then in one partition, so join and aggregation run without moving a single pair row; only
  ratings are copied, blocks + 1 times.

`auto` counts raters per item and takes the grid if it copies fewer ratings than there are pair rows, else the lists. All are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4096
# Pair rows that one task of the lists aggregates, about; a user with more is cut into parts.
TASK_PAIRS = 1_000_000
# Times travel in days where all of them are whole days in seconds.
DAY = 86_400
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def grid_blocks(spark: SparkSession) -> int:
    """Blocks such that the cells are about four times as many as the shuffle partitions."""
    return max(4, math.ceil(math.sqrt(8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def user_block(user: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(user), blocks.cast("bigint")).cast("int")


def _low_side(df: DataFrame, blocks: Column) -> DataFrame:
    return (df.withColumn("low", user_block(F.col("u"), blocks))
            .withColumn("high", F.explode(F.sequence(F.col("low"), (blocks - 1).cast("int")))))


def _high_side(df: DataFrame, blocks: Column) -> DataFrame:
    return (df.withColumn("high", user_block(F.col("v"), blocks))
            .withColumn("low", F.explode(F.sequence(F.lit(0), F.col("high")))))


def count_meetings(ratings: DataFrame, keys: list[str]) -> tuple[float, float, float]:
    """Ratings, pair rows and the most raters of an item (one small aggregate)."""
    raters = ratings.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    n, pairs, most = raters.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2), F.max("n")).first()
    return n or 0, pairs or 0, most or 0


def _ends(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, int]]:
    """The least and the largest value of each integer column and the unit they are whole multiples of: a day (as seconds) or 1."""
    whole = [f.name for f in df.schema if f.name in columns and f.dataType.typeName() in ("byte", "short", "integer", "long")]
    ends = df.agg(*[f(c).cast("bigint").alias(f"{f.__name__}_{c}") for c in whole for f in (F.min, F.max)],
                  *[F.count_if(F.col(c).cast("bigint") % DAY != 0).alias(f"odd_{c}") for c in whole]).first() if whole else ()
    unit = {c: 1 if c == "user_id" or ends[f"odd_{c}"] else DAY for c in whole}  # ids are compared as they travel
    return {c: ((ends[f"min_{c}"] or 0) // unit[c], (ends[f"max_{c}"] or 0) // unit[c], unit[c]) for c in whole}


def _narrow(df: DataFrame, columns: list[str], ends: dict[str, tuple[int, int, int]] | None = None) -> dict[str, tuple[str, int]]:
    """The narrowest integer type that holds all values of each integer column, counted in days (as seconds) if all are whole days."""
    ends = _ends(df, columns) if ends is None else ends
    fits = lambda low, high, bits: -(1 << bits) <= low and high < 1 << bits
    return {c: (next((t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if fits(low, high, bits)), "bigint"), unit)
            for c, (low, high, unit) in ends.items()}


@dataclass
class Code:
    """One number for several integer columns side by side, in `kinds` columns w0, w1, ... that together are as narrow as its bits allow.

    `at`: place, bits, least value and unit of each column; a value is counted from 1, null is 0.
    """
    at: dict[str, tuple[int, int, int, int]]
    kinds: list[str]

    def words(self, values: dict[str, Column]) -> list[Column]:
        one = None
        for c, (place, _, low, unit) in self.at.items():
            value = F.coalesce(_packed(values[c], "bigint", unit) - F.lit(low - 1), F.lit(0).cast("bigint"))
            one = F.shiftleft(value, place) if one is None else one.bitwiseOR(F.shiftleft(value, place))
        # The lowest bits of a shifted number, as a signed one of that width.
        done, words = 0, []
        for i, kind in enumerate(self.kinds):
            left = 64 - BITS[kind]
            words.append(F.shiftright(F.shiftleft(F.shiftrightunsigned(one, done), left), left).cast(kind).alias(f"w{i}"))
            done += BITS[kind]
        return words

    def values(self, types: dict) -> dict[str, Column]:
        one, done = None, 0
        for i, kind in enumerate(self.kinds):
            word = F.col(f"w{i}").cast("bigint")
            word = F.shiftleft(word if BITS[kind] == 64 else word.bitwiseAND(F.lit((1 << BITS[kind]) - 1)), done)
            one, done = word if one is None else one.bitwiseOR(word), done + BITS[kind]
        out = {}
        for c, (place, bits, low, unit) in self.at.items():
            code = F.shiftrightunsigned(one, place).bitwiseAND(F.lit((1 << bits) - 1))
            out[c] = F.when(code != 0, (code + F.lit(low - 1)) * F.lit(unit)).cast(types[c])
        return out


def _code(ends: dict[str, tuple[int, int, int]]) -> Code | None:
    """How the columns travel as one number; None if it has more than 63 bits."""
    at, place = {}, 0
    for c, (low, high, unit) in ends.items():
        bits = (high - low + 1).bit_length()
        at[c] = (place, bits, low, unit)
        place += bits
    kinds, left = [], place
    while left > 0:
        # Three bytes are a smallint and a tinyint, five an int and a tinyint, and so on.
        kinds.append("int" if left > 24 else "smallint" if left > 8 else "tinyint")
        left -= BITS[kinds[-1]]
    return Code(at, kinds) if place < 64 and all(abs(low) < 1 << 62 for low, _, _ in ends.values()) else None


def _packed(column: Column, kind: str, unit: int) -> Column:
    return (column if unit == 1 else F.floor(column.cast("bigint") / F.lit(unit))).cast(kind)


def task_count(spark: SparkSession, pairs: float, task_pairs: int = TASK_PAIRS) -> int:
    """Tasks that aggregate so many pair rows of the lists: some more than they need while the session has partitions for them."""
    return max(1, math.ceil(max(pairs / task_pairs, min(10 * pairs / task_pairs, int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def _parts(sized: DataFrame, most: float, task_pairs: int) -> DataFrame | None:
    """(user_id, _parts) of the users with more than `task_pairs` meetings, or None if there can be none."""
    busiest = sized.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if busiest * most <= task_pairs:
        return None
    meetings = sized.groupBy("user_id").agg(F.sum("_raters").alias("n")).where(F.col("n") > task_pairs)
    return meetings.select("user_id", F.ceil(F.col("n") / task_pairs).cast("int").alias("_parts"))


def _lists(some: DataFrame, everyone: DataFrame, keys: list[str], own: list[str], carry: list[str], keep, most: float,
           chunk: int = CHUNK, task_pairs: int = TASK_PAIRS, marks: list[str] | None = None, code: Code | None = None) -> tuple[DataFrame, list[str], dict[str, tuple[str, int]]]:
    """Raters u out of `some` with u_* (`own`), the keys and lists v, v_* (`carry`) of those raters of the same item that `keep` allows, given v with its columns and u.

    Also returns ["part"] if users are cut into parts, and the types and units the lists are in. `most` is the most raters of an item in `everyone`. Columns in `marks` are there for `keep` alone.
    With `code` the lists are w0, w1, ...: v and its integer columns in one number.
    """
    def sized(df):
        return df.join(everyone.groupBy(*keys).agg(F.count("*").alias("_raters")), keys).withColumn("_cells", F.ceil(F.col("_raters") / chunk).cast("int"))
    types = {} if code else _narrow(everyone, ["user_id", *carry])
    cast = lambda c: _packed(F.col(c), *types[c]) if c in types else F.col(c)
    plain = [c for c in carry if not (code and c in code.at)]
    other = F.struct(cast("user_id").alias("v"), *[cast(c).alias(f"v_{c}") for c in [*plain, *(marks or [])]],
                     *(code.words({c: F.col(c) for c in code.at}) if code else []))
    lists = (sized(everyone).groupBy(*keys, user_block(F.col("user_id"), F.col("_cells")).alias("list"))
             .agg(F.collect_list(other).alias("met")))
    asking = sized(some)
    heavy, part = _parts(asking, most, task_pairs), []
    met = asking.withColumn("list", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).join(lists, [*keys, "list"])
    wanted = F.filter("met", lambda x: keep(x, F.col("user_id")))
    if heavy is not None:
        part = ["part"]
        met = (met.join(F.broadcast(heavy), "user_id", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
               .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))))
        wanted = F.filter(wanted, lambda x: user_block(x["v"].cast("bigint"), F.col("_parts")) == F.col("part"))
    names = ([f"w{i}" for i in range(len(code.kinds))] if code else ["v"]) + [f"v_{c}" for c in plain]
    return (met.withColumn("met", wanted).where(F.size("met") > 0)
            .select(F.col("user_id").alias("u"), *part, *keys, *[F.col(c).alias(f"u_{c}") for c in own], *[F.col("met")[n].alias(n) for n in names])), part, types


def _listed(some: DataFrame, everyone: DataFrame, keys: list[str], carry: list[str], keep, pairs: float, most: float,
            chunk: int = CHUNK, task_pairs: int = TASK_PAIRS, marks: list[str] | None = None, homes: int | None = None) -> tuple[DataFrame, list[str]]:
    """The lists moved to u, as pair rows (u, v, item_id, u_*, v_* and the other keys), and the columns to group by together with (u, v).

    `pairs` is about the number of rows; see `_lists` for the others. With `homes` the lists lie by the home of u, its hash modulo so many, not by u.
    """
    code = _code(_ends(everyone, ["user_id", *carry]))
    met, part, types = _lists(some, everyone, keys, carry, carry, keep, most, chunk, task_pairs, marks, code)
    at, besides = [*keys[:-1], "u", *part], []
    if homes:
        met = met.withColumn("home", user_block(F.col("u"), F.lit(homes)))
        at, besides = [*keys[:-1], "home", *part], ["u"]
    rows = _pair_rows(met, some, everyone, carry, types, at, besides, pairs, task_pairs, code)
    return rows, [c for c in at if c != "u"]


def _pair_rows(met: DataFrame, some: DataFrame, everyone: DataFrame, carry: list[str], types: dict[str, tuple[str, int]], at: list[str],
               besides: list[str], pairs: float, task_pairs: int, code: Code | None) -> DataFrame:
    """Lists dealt by the columns `at`, as pair rows with these, the columns `besides` and the values as they were."""
    words = [f"w{i}" for i in range(len(code.kinds))] if code else []
    names = (words or ["v"]) + [f"v_{c}" for c in carry if not (code and c in code.at)]
    # A given number of tasks stays: the lists are several times as large once they are pair rows.
    both = (met.repartition(task_count(some.sparkSession, pairs, task_pairs), *at)
            .select(*at, *besides, "item_id", *[f"u_{c}" for c in carry], F.inline(F.arrays_zip(*names))))
    if code:
        values = code.values({c: everyone.schema[c].dataType for c in code.at})
        return both.withColumns({"v" if c == "user_id" else f"v_{c}": value for c, value in values.items()}).drop(*words)

    def unpacked(n, c):
        unit = types[c][1] if c in types else 1
        return (F.col(n) if unit == 1 else F.col(n).cast("bigint") * F.lit(unit)).cast(everyone.schema[c].dataType)
    wide = {n: unpacked(n, c) for n, c in zip(names, ["user_id", *carry], strict=True)}
    return both.withColumns(wide)


def rater_pairs(ratings: DataFrame, carry: list[str], within: str | None = None, way: str = "auto",
                blocks: int | None = None, chunk: int = CHUNK, task_pairs: int = TASK_PAIRS) -> tuple[DataFrame, list[str]]:
    """Every unordered pair of different raters of an item, once.

    `ratings` has user_id, item_id, the carried columns and, if pairs must share it, `within`.
    Returns the pair rows (u, v, item_id, u_*, v_* and `within`) with u < v, and the columns to
    group by together with (u, v): with the grid and the lists these keep the aggregation inside its partition.
    """
    spark = ratings.sparkSession
    group = [within] if within else []
    keys = group + ["item_id"]
    blocks = blocks or grid_blocks(spark)
    if way in ("auto", "lists"):
        n, pairs, most = count_meetings(ratings, keys)
        if way == "lists" or pairs <= n * (blocks + 1):
            return _listed(ratings, ratings, keys, carry, lambda v, user: v["v"] > user, pairs, most, chunk, task_pairs)
        way = "grid"

    if way == "grid":
        size, extra = F.lit(blocks), []
    else:
        raters = ratings.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_cells"))
        ratings, size, extra = ratings.join(raters, keys), F.col("_cells"), ["_cells"]

    columns = lambda who: [F.col("user_id").alias(who), *keys, *extra,
                           *[F.col(c).alias(f"{who}_{c}") for c in carry]]
    left = _low_side(ratings.select(*columns("u")), size).drop(*extra)
    right = _high_side(ratings.select(*columns("v")), size).drop(*extra)
    cell = group + ["low", "high"]
    if way == "grid":
        # sizes are estimated without the copies, so Spark must not take a side for small
        left, right = left.repartition(*cell), right.repartition(*cell).hint("merge")

    met = left.join(right, [*keys, "low", "high"]).where((F.col("low") < F.col("high")) | (F.col("u") < F.col("v")))
    swap = F.col("u") > F.col("v")
    pick = lambda a, b, name: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)
    sides = [pick("u", "v", "u"), pick("v", "u", "v")]
    for c in carry:
        sides += [pick(f"u_{c}", f"v_{c}", f"u_{c}"), pick(f"v_{c}", f"u_{c}", f"v_{c}")]
    return met.select(*cell, "item_id", *sides), (cell if way == "grid" else group)


def to_cells(df: DataFrame, user: str, blocks: int) -> DataFrame:
    """Copy each row into every cell that its user's block is part of."""
    own = user_block(F.col(user), F.lit(blocks))
    other = F.col("_other")
    return (df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", other))
            .drop("_own", "_other"))


def cell_of(user1: str, user2: str, blocks: int) -> tuple[Column, Column]:
    b1, b2 = (user_block(F.col(u), F.lit(blocks)) for u in (user1, user2))
    return F.least(b1, b2), F.greatest(b1, b2)


def listed_with(some: DataFrame, everyone: DataFrame, keys: list[str], carry: list[str], chunk: int = CHUNK, task_pairs: int = TASK_PAIRS,
                once: str | None = None, homes: int | None = None, either: str | None = None) -> tuple[DataFrame, list[str]]:
    """Pairs of one rater out of `some` with any other rater of the same item, and the columns to group by together with (u, v).

    Raters of an item meet in lists (see above), so the aggregation stays where the pair rows are. `once` names a boolean
    column of `everyone` that marks the raters in `some`: two of them meet only as u < v. `either` names one of both: raters
    that do not have it meet only those that do. `homes`: see `_listed`.
    """
    size = lambda df, name: df.groupBy(*keys).agg(F.count("*").cast("double").alias(name))
    pairs, most = size(some, "n").join(size(everyone, "of"), keys).agg(F.sum(F.col("n") * F.col("of")), F.max("of")).first()

    def keep(v, user):
        if either:
            return (v["v"] != user) & (F.col(either) | v[f"v_{either}"])
        return (v["v"] > user) | ((v["v"] != user) & ~v[f"v_{once}"]) if once else v["v"] != user
    return _listed(some, everyone, keys, carry, keep, pairs or 0, most or 0, chunk, task_pairs, [m for m in (once, either) if m], homes)


def pairs_with(some: DataFrame, everyone: DataFrame, keys: list[str], carry: list[str], chunk: int = CHUNK) -> DataFrame:
    """The pair rows of `listed_with`."""
    return listed_with(some, everyone, keys, carry, chunk)[0]


def meet_by_smaller(askers: DataFrame, raters: DataFrame, value: str, tasks: int) -> DataFrame:
    """(u < v, asks, item_id, value) of each asker and each other rater of an item; asks: u is the asker and v the rater.

    The rows lie with u, in so many tasks: next to the pairs of `rater_pairs` by lists if that has as many.
    """
    size = lambda df, name: df.groupBy("item_id").agg(F.count("*").alias(name))
    most = size(askers, "a").join(size(raters, "r"), "item_id").agg(F.max("a"), F.max("r")).first()
    larger = lambda v, user: v["v"] > user
    forth, cut, _ = _lists(askers, raters, ["item_id"], [], [value], larger, most[1] or 0)
    back, also, _ = _lists(raters, askers, ["item_id"], [value], [], larger, most[0] or 0)
    part = cut or also
    same = lambda df, has: df if has or not part else df.withColumn("part", F.lit(0))
    met = (same(forth, cut).withColumns({"asks": F.lit(True), f"u_{value}": F.lit(None).cast("double")})
           .unionByName(same(back, also).withColumns({"asks": F.lit(False), f"v_{value}": F.lit(None).cast("array<double>")})))
    values = F.when(F.col("asks"), F.col(f"v_{value}")).otherwise(F.array_repeat(F.col(f"u_{value}"), F.size("v")))
    return (met.repartition(tasks, "u", *part).select("u", "asks", "item_id", F.inline(F.arrays_zip(F.col("v").alias("v"), values.alias(value))))
            .withColumn("v", F.col("v").cast("bigint")))
