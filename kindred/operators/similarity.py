"""User similarity: overlap, usefulness, agreement and time closeness, folded into one score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import scalar as fx
from kindred.operators import pairs
from kindred.operators.ratings import items_per_user, rating_side, user_stats
from kindred.session import BROADCAST_ROWS, store


def corated_pairs(ratings: DataFrame, within: str | None = None, way: str = "auto") -> DataFrame:
    """(user_u < user_v, item_id, both ratings, both times) for every item two users share."""
    if way == "auto":
        way = "join"  # every pair row is an output row, so there is no aggregation to keep local
    met, _ = pairs.rater_pairs(ratings, ["rating", "ts"], within, way)
    group = [within] if within else []
    return met.select(*group, F.col("u").alias("user_u"), F.col("v").alias("user_v"), "item_id",
                      F.col("u_rating").alias("rating_u"), F.col("v_rating").alias("rating_v"),
                      F.col("u_ts").alias("ts_u"), F.col("v_ts").alias("ts_v"))


def with_sides(ratings: DataFrame, averages: DataFrame | None, keep: list[str]) -> DataFrame:
    """Ratings with the user's item count and the side of the mean the rating lies on."""
    stats = user_stats(ratings)
    if averages is not None:
        stats = stats.drop("avg_rating").join(averages.select("user_id", "avg_rating"), "user_id")
    return (ratings.join(stats, "user_id")
            .select("user_id", "item_id", *keep, "ts", "n_items",
                    rating_side(F.col("rating"), F.col("avg_rating")).alias("side")))


def pair_factors(ratings: DataFrame, averages: DataFrame | None = None, within: str | None = None,
                 strict: bool = False, alpha: float = fx.TIME_DECAY, factors=("rc", "rd", "rt"),
                 way: str = "auto", blocks: int | None = None, counts: bool = True) -> DataFrame:
    """Symmetric factors of every pair with a common item: (user_u < user_v, rc, rd, rt, n_u, n_v).

    Expects one row per (user, item). Item counts (left out with `counts=False`) travel with the rating rows, so the usefulness
    needs no join of the far larger pair table with the users. The prepared ratings are stored
    once; counting raters and both sides of the join read that table.
    """
    need = {"rc": [], "rd": ["side"], "rt": ["ts"]}
    carry = ["n_items"] * counts + [c for f in factors for c in need[f]]
    sums = {"rc": F.count("*"),
            "rd": F.sum(fx.same_side(F.col("u_side"), F.col("v_side"), strict)),
            "rt": F.sum(fx.time_closeness(F.col("u_ts"), F.col("v_ts"), alpha))}
    if counts or "rd" in factors or averages is not None:
        prepared = with_sides(ratings, averages, [within] if within else [])
    else:  # nothing is asked of the users, so ratings need not meet them
        prepared = ratings.where("user_id is not null").select("user_id", "item_id", *([within] if within else []), "ts")
    prepared = store(prepared, "sided-ratings")
    met, local = pairs.rater_pairs(prepared, carry, within, way, blocks)
    n = {"n_u": F.max("u_n_items"), "n_v": F.max("v_n_items")} if counts else {}
    return (met.groupBy(*local, "u", "v")
            .agg(*[sums[f].alias(f) for f in factors], *[c.alias(name) for name, c in n.items()])
            .select(*([within] if within else []), F.col("u").alias("user_u"), F.col("v").alias("user_v"),
                    *factors, *n))


def mirror(half: DataFrame, *symmetric: str) -> DataFrame:
    """Both directions of each pair; the item counts change places."""
    keep = [c for c in half.columns if c not in ("user_u", "user_v", "n_u", "n_v")]
    names = [c for c in ("user_u", "user_v", "n_u", "n_v") if c in half.columns]
    side = lambda *of: F.struct(*[F.col(c).alias(name) for c, name in zip(of, names, strict=True)])
    both = F.explode(F.array(side(*names), side(*[names[i ^ 1] for i in range(len(names))])))
    return half.select(both.alias("d"), *keep).select("d.*", *(symmetric or keep))


def rating_commodity(ratings: DataFrame, **kw) -> DataFrame:
    """RC: number of common items, both directions."""
    return mirror(pair_factors(ratings, factors=("rc",), counts=False, **kw)).select("user_u", "user_v", "rc")


def rating_usefulness(ratings: DataFrame, **kw) -> DataFrame:
    """RU(u, v): number of items v has and u has not, for pairs with a common item."""
    return (mirror(pair_factors(ratings, factors=("rc",), **kw))
            .select("user_u", "user_v", (F.col("n_v") - F.col("rc")).alias("ru")))


def rating_details(ratings: DataFrame, averages: DataFrame | None = None, strict: bool = False, **kw) -> DataFrame:
    """RD: number of common items both users rated on the same side of their own mean."""
    half = pair_factors(ratings, averages, strict=strict, factors=("rd",), counts=False, **kw)
    return mirror(half).select("user_u", "user_v", "rd")


def rating_time(ratings: DataFrame, alpha: float = fx.TIME_DECAY, **kw) -> DataFrame:
    """RT: sum over common items of exp(-alpha * time difference)."""
    return mirror(pair_factors(ratings, alpha=alpha, factors=("rt",), counts=False, **kw)).select("user_u", "user_v", "rt")


def score_pairs(half: DataFrame) -> DataFrame:
    """Directed factors and score from symmetric ones."""
    ru = F.col("n_v") - F.col("rc")
    group = [c for c in half.columns if c not in ("user_u", "user_v", "rc", "rd", "rt", "n_u", "n_v")]
    return (mirror(half).withColumn("ru", ru)
            .select(*group, "user_u", "user_v", "rc", "ru", "rd", "rt",
                    fx.mfps_score(F.col("rc"), ru, F.col("rd"), F.col("rt")).alias("mfps")))


def mfps(ratings: DataFrame, averages: DataFrame | None = None, within: str | None = None,
         strict: bool = False, alpha: float = fx.TIME_DECAY, keep: str | None = None, **kw) -> DataFrame:
    """Directed similarity (user_u, user_v, rc, ru, rd, rt, mfps) of all pairs with a common item.

    With `within` (a column of `ratings`, such as the cluster label) pairs must share its value;
    all clusters are computed in the same job. `keep`: the symmetric factors are stored under that name, one row per pair, so
    that several steps can read the result.
    """
    half = pair_factors(ratings, averages, within, strict, alpha, **kw)
    return score_pairs(store(half, keep) if keep else half)


def mfps_by_user(ratings: DataFrame, homes: int, averages: DataFrame | None = None, strict: bool = False,
                 alpha: float = fx.TIME_DECAY) -> DataFrame:
    """The rows of `mfps`, where both directions of a pair are summed, each with its user_u; nothing moves after that.

    `homes`: users with equal pmod(xxhash64(user_u), homes) are together, so a store in as many parts (or a divisor of them)
    can be written as the rows lie. Raters move twice as often as for `mfps`, pairs not at all, except where `mfps` sums them in a grid:
    then each row moves to its home.
    """
    spark = ratings.sparkSession
    prepared = store(with_sides(ratings, averages, []), "sided-ratings")
    n, rows, _ = pairs.count_meetings(prepared, ["item_id"])
    if rows > n * (pairs.grid_blocks(spark) + 1):
        home = pairs.user_block(F.col("user_u"), F.lit(homes))
        return mfps(ratings, averages, None, strict, alpha).repartition(pairs.task_count(spark, 2 * rows), home)
    met, local = pairs.listed_with(prepared, prepared, ["item_id"], ["n_items", "side", "ts"], homes=homes)
    return directed_scores(met, local, strict, alpha)


def directed_scores(met: DataFrame, local: list[str], strict: bool, alpha: float) -> DataFrame:
    """Directed factors and score of u and v from pair rows that hold both directions, grouped where they lie."""
    sums = met.groupBy(*local, "u", "v").agg(
        F.count("*").alias("rc"), F.sum(fx.same_side(F.col("u_side"), F.col("v_side"), strict)).alias("rd"),
        F.sum(fx.time_closeness(F.col("u_ts"), F.col("v_ts"), alpha)).alias("rt"), F.max("v_n_items").alias("n_v"))
    ru = F.col("n_v") - F.col("rc")
    return sums.select(F.col("u").alias("user_u"), F.col("v").alias("user_v"), "rc", ru.alias("ru"), "rd", "rt",
                       fx.mfps_score(F.col("rc"), ru, F.col("rd"), F.col("rt")).alias("mfps"))


def half_scores(ratings: DataFrame, **kw) -> DataFrame:
    """Both scores of each pair in one row (user_u < user_v, forth: of v for u, back: of u for v), where the pair was summed."""
    half = pair_factors(ratings, **kw)
    score = lambda n: fx.mfps_score(F.col("rc"), F.col(n) - F.col("rc"), F.col("rd"), F.col("rt"))
    return half.select("user_u", "user_v", score("n_v").alias("forth"), score("n_u").alias("back"))


def combine_factors(rc: DataFrame, ru: DataFrame, rd: DataFrame, rt: DataFrame) -> DataFrame:
    """Score from four separately stored factor relations, joined on the pair."""
    key = ["user_u", "user_v"]
    return (rc.join(ru, key).join(rd, key).join(rt, key)
            .withColumn("mfps", fx.mfps_score(F.col("rc"), F.col("ru"), F.col("rd"), F.col("rt"))))


def neighbours(similarity: DataFrame, k: int = 50) -> DataFrame:
    """The k most similar users of each user; the smaller id wins a tie.

    Each task cuts to k per user before the shuffle (window group limit), so a user with very
    many neighbours does not make one large task.
    """
    order = Window.partitionBy("user_u").orderBy(F.desc("mfps"), "user_v")
    return (similarity.select("user_u", "user_v", "mfps")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def stranger_scores(ratings: DataFrame) -> DataFrame:
    """Score of a pair without common items when absent factors are skipped: 1 / (1 + 1/n_v).

    It depends on user_v alone, so the dense pair table never has to be built.
    """
    zero = F.lit(0.0)
    return items_per_user(ratings).select(
        F.col("user_id").alias("user_v"),
        fx.mfps_score(zero, F.col("n_items"), zero, zero).alias("stranger"))


def similarity_of(wanted: DataFrame, similarity: DataFrame, ratings: DataFrame | None = None,
                  zero_rc: str = "zero") -> DataFrame:
    """Score of given (user_u, user_v) pairs, including those without common items.

    zero_rc: 'drop' leaves such pairs out, 'zero' gives 0, 'skip' leaves absent factors out of
    the sum (needs `ratings`).
    """
    known = similarity.select("user_u", "user_v", "mfps")
    for who in ("user_u", "user_v"):
        # Where few users are asked for, the other pairs leave before anything moves.
        asked = wanted.select(who).distinct()
        if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            known = known.join(F.broadcast(asked), who, "left_semi")
    if zero_rc == "drop":
        return wanted.join(known, ["user_u", "user_v"])
    looked_up = wanted.join(known, ["user_u", "user_v"], "left")
    if zero_rc == "zero":
        return looked_up.withColumn("mfps", F.coalesce("mfps", F.lit(0.0)))
    return (looked_up.join(stranger_scores(ratings), "user_v")
            .withColumn("mfps", F.coalesce("mfps", "stranger")).select("user_u", "user_v", "mfps"))
