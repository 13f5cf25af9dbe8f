"""Clustering of users by mean-filled profiles: seeding by importance and distance, then refinement.

No dense vector is ever built. A profile is the user's mean `base` plus deviations on rated items,
and so is a mean of profiles. With N items, S the sum and Q the sum of squares of the deviations:

    |x - c|^2 = N (base_x - base_c)^2 + 2 (base_x - base_c)(S_x - S_c) + Q_x + Q_c - 2 sum_i dev_xi dev_ci

so only the last sum needs a join, on the centroids' items. Centroids are laid side by side, one
column each: a rating row meets one row, not one per centroid. That table is broadcast; where it is too large for that,
a prepared profile lies in item ranges, and each range of the centroids is broadcast in turn. A broadcast passes the driver,
so the rounds of a refinement share an allowance; what exceeds it meets the centroids by shuffle.

Refinement keeps two bounds per user, one above the distance to the own centroid and one below the
distance to all others. A centroid's move changes them by at most its length (triangle inequality), so a
round computes distances only for users whose bounds meet, and adds up only users that changed cluster.

The loops read scalars and one row per centroid on the driver; everything else stays in Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.ratings import importance, max_scale, top_user, user_profile
from kindred.operators.selection import nth_smallest, up_to
from kindred.session import BROADCAST_ROWS, cut_lineage, store, store_bucketed

# Ratings of one user that may lie in one partition of a prepared profile.
SLOT_ROWS = 100_000
# Numbers the centroids laid side by side may hold to be broadcast (8 bytes each): 32 MB.
BROADCAST_CELLS = 4_000_000
# Numbers that all rounds of a refinement may broadcast together, of centroids and of users: 128 MB.
BROADCAST_TOTAL = 16_000_000
# Distances are compared to 6 places; users whose bounds are closer than this are computed.
MARGIN = 1e-5
# Up to so many centroids, a round also uses the distances between them.
PAIRED = 32


@dataclass
class Seeding:
    """seeds (ordinal, label, score), centroids (ordinal, label, base, item_id, dev) and the users
    that were discarded around each seed (user_id, label, ordinal)."""
    seeds: DataFrame
    centroids: DataFrame
    members: DataFrame


@dataclass
class Allowance:
    """How many numbers may still be broadcast."""
    left: int

    def take(self, cells: int) -> bool:
        """Whether so many may be broadcast; they are counted then."""
        if cells > self.left:
            return False
        self.left -= cells
        return True


def prepare_profile(ratings: DataFrame, averages: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Profile for the loops: stored once, bucketed by user, so no round shuffles ratings.

    A user with very many ratings is cut into slots, each a bucket key of its own. If `k` centroids are too large
    to be broadcast, the items are dealt into ranges (column `range`, a folder each) whose centroids are not.
    """
    profile = user_profile(ratings, averages)
    parts = ratings.groupBy("user_id").agg(F.ceil(F.count("*") / SLOT_ROWS).alias("parts"))
    slot = F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")
    profile = profile.join(parts, "user_id").withColumn("slot", slot).drop("parts")
    ranges = math.ceil(count_items(ratings) * (k + 1) / BROADCAST_CELLS)
    if ranges > 1:
        return store_bucketed(profile.withColumn("range", _range_of(ranges)), "profile", "user_id", "slot", folders=["range"])
    return store_bucketed(profile, "profile", "user_id", "slot")


def _range_of(ranges: int):
    return F.pmod(F.xxhash64("item_id", F.lit(11)), F.lit(ranges)).cast("int")


def _by_slot(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id", "slot")


def count_items(profile: DataFrame) -> int:
    return profile.select("item_id").distinct().count()


def pick_centroid(profile: DataFrame, seeds: DataFrame) -> DataFrame:
    """Profile rows of the seed users (ordinal, label): one centroid each."""
    return (profile.join(F.broadcast(seeds.select("ordinal", "label")), F.col("user_id") == F.col("label"))
            .select("ordinal", "label", "base", "item_id", "dev"))


@dataclass
class Head:
    """What a centroid's distances need besides its deviations: name, mean, sum, sum of squares.

    Its deviations are the columns laid side by side divided by `n`.
    """
    ordinal: int
    label: int
    base: float
    s: float
    q: float
    n: float = 1.0


def _heads(centroids: DataFrame) -> list[Head]:
    rows = (centroids.groupBy("ordinal", "label")
            .agg(F.max("base").alias("base"), F.sum("dev").alias("s"), F.sum(F.col("dev") * F.col("dev")).alias("q"))
            .orderBy("ordinal").collect())
    return [Head(r["ordinal"], r["label"], r["base"], r["s"], r["q"]) for r in rows]


def _side_by_side(centroids: DataFrame, heads: list[Head]) -> DataFrame:
    """item_id and the centroids' deviations c0, c1, ... (0 where a centroid has none)."""
    return centroids.groupBy("item_id").agg(*[
        F.sum(F.when(F.col("ordinal") == h.ordinal, F.col("dev")).otherwise(0.0)).alias(f"c{i}") for i, h in enumerate(heads)])


def _products(profile: DataFrame, wide: DataFrame, k: int, carry: tuple = (), allowance: Allowance | None = None) -> DataFrame:
    """Per user base, s, q and the products dot0, dot1, ... with the columns c0, c1, ... of `wide` (stored).

    Columns in `carry` hold one value per user. Whether `wide` is broadcast follows from the number of its cells and what `allowance` has left.
    """
    sums = {"s": "sum(dev)", "q": "sum(dev * dev)"}
    dots = {f"dot{i}": f"sum(dev * coalesce(c{i}, 0D))" for i in range(k)}
    same = [F.max(c).alias(c) for c in ("base", *carry)]
    keys = ["user_id", "slot"] if "slot" in profile.columns else ["user_id"]

    def summed(rows, sums):
        return rows.groupBy(*keys).agg(*same, *[F.expr(v).alias(n) for n, v in sums.items()])

    def by_user(parts, names):
        return parts if keys == ["user_id"] else parts.groupBy("user_id").agg(*same, *[F.sum(n).alias(n) for n in names])

    wide = wide.select("item_id", *[f"c{i}" for i in range(k)])
    cells = wide.count() * (k + 1)
    small, ranged = cells <= BROADCAST_CELLS, "range" in profile.columns
    if not (small or ranged) or not (allowance is None or allowance.take(cells)):
        # Only what a product needs moves to the items and back; the rest is summed where the profile lies.
        own = by_user(summed(profile, sums), sums)
        met = profile.select("user_id", "item_id", "dev").join(wide.hint("merge"), "item_id")
        met = met.groupBy("user_id").agg(*[F.expr(v).alias(n) for n, v in dots.items()])
        return own.join(met, "user_id", "left").select(*own.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in dots])
    sums |= dots
    if small:
        return by_user(summed(profile.join(F.broadcast(wide), "item_id", "left"), sums), sums)
    # Each range is a job of its own: its centroids leave memory before the next one's come.
    ranges = 1 + (profile.agg(F.max("range")).first()[0] or 0)
    parts = [store(summed(profile.where(F.col("range") == r).join(F.broadcast(wide.where(_range_of(ranges) == r)), "item_id", "left"), sums), "products")
             for r in range(ranges)]
    users = parts[0]
    for part in parts[1:]:
        users = users.unionByName(part)
    return users.groupBy("user_id").agg(*same, *[F.sum(n).alias(n) for n in sums])


def _number(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else "double('infinity')"


def _array(values) -> str:
    """SQL of an array of doubles; a folded array is no part of generated code, so rounds share their compiled classes."""
    return f"array({', '.join(_number(float(v)) for v in values)})"


def _distance_array(heads: list[Head], n_items: int) -> str:
    """SQL: structs (at, distance) of a row of `_products`, one per centroid in order."""
    given = ", ".join(f"named_struct('at', {i}, 'base', {_number(h.base)}, 's', {_number(h.s)}, 'q', {_number(h.q)}, 'n', {_number(h.n)})"
                      for i, h in enumerate(heads))
    square = (f"{float(n_items)}D * (base - h.base) * (base - h.base) + 2 * (base - h.base) * (s - h.s) + q + h.q - 2 * dot / h.n")
    return (f"zip_with(array({given}), array({', '.join(f'dot{i}' for i in range(len(heads)))}), "
            f"(h, dot) -> struct(h.at as at, sqrt(greatest({square}, 0D)) as distance))")


def _nearest(users: DataFrame, heads: list[Head], n_items: int) -> DataFrame:
    """`users` (rows of `_products`) with `at` (the first of the nearest centroids), `upper` (its distance) and `lower` (that of the nearest other).

    Distances are sums in no fixed order, so they are compared to 6 places.
    """
    return (users.withColumn("options", F.expr(
                f"transform({_distance_array(heads, n_items)}, o -> struct(floor(o.distance * 1e6D + 0.5D) as near, o.at as at, o.distance as distance))"))
            .withColumn("best", F.array_min("options"))
            .withColumns({"at": F.col("best.at"), "upper": F.col("best.distance"), "lower": F.expr(
                "coalesce(array_min(transform(filter(options, o -> o.at != best.at), o -> o.distance)), double('infinity'))")})
            .drop("options", "best"))


def _placed(profile: DataFrame, centroids: DataFrame, n_items: int | None) -> tuple[DataFrame, list[Head]]:
    """Every user with its nearest centroid, and the centroids' heads."""
    n_items = count_items(profile) if n_items is None else n_items
    heads = _heads(centroids)
    users = _products(profile, cut_lineage(_side_by_side(centroids, heads)), len(heads))
    return _nearest(users, heads, n_items), heads


def _named(users: DataFrame, heads: list[Head], distance) -> DataFrame:
    """(user_id, label, ordinal, distance, base) from the number `at` of each user's centroid."""
    names = "array(" + ", ".join(f"named_struct('ordinal', {h.ordinal}, 'label', bigint({h.label}))" for h in heads) + ")"
    name = F.get(F.expr(names), F.col("at"))
    return users.select("user_id", name["label"].alias("label"), name["ordinal"].alias("ordinal"), distance.alias("distance"), "base")


def distance_to_centroid(profile: DataFrame, centroid: DataFrame, n_items: int | None = None) -> DataFrame:
    """Euclidean distance of every user to one centroid."""
    return _placed(profile, centroid, n_items)[0].select("user_id", F.col("upper").alias("distance"))


def m_nearest(distances: DataFrame, m: int) -> DataFrame:
    """The m users with the smallest distance; smaller ids first among equals.

    Distances are materialised first: the cutoff has to come from the very sums it is compared with.
    """
    distances = cut_lineage(distances)
    return distances.where(up_to("distance", "user_id", nth_smallest(distances, "distance", "user_id", m)))


def nearest_count(n_users: int, k: int) -> int:
    return int(n_users / k / 1.5) + 1


def discard_users(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select("user_id"), "user_id", "left_anti")


def seed_score(values: DataFrame, max_importance=None) -> DataFrame:
    """Importance and distance of (user_id, importance, distance), each scaled by its maximum, added."""
    scaled = max_scale(values, "distance", "scaled_distance")
    if max_importance is None:
        scaled = max_scale(scaled, "importance", "scaled_importance")
    else:
        scaled = scaled.withColumn("scaled_importance", F.try_divide(F.col("importance").cast("double"), F.lit(max_importance)))
    total = F.coalesce("scaled_importance", F.lit(0.0)) + F.coalesce("scaled_distance", F.lit(0.0))
    return scaled.withColumn("score", total)


def seed_centroids(profile: DataFrame, user_importance: DataFrame, k: int = 5, f_scale: str = "global",
                   m: int | None = None, n_items: int | None = None) -> Seeding:
    """The most important user first; then k-1 times the user with the best importance + distance to
    the newest seed, after the m users nearest to that seed have left the pool.

    f_scale: importance is scaled by its maximum over all users ('global') or over the users still
    in the pool ('pool').
    """
    spark = profile.sparkSession
    n_items = count_items(profile) if n_items is None else n_items
    pool = cut_lineage(user_importance.select("user_id", "importance"))
    n_users, largest = pool.agg(F.count("*"), F.max(F.col("importance").cast("double"))).first()
    m = nearest_count(n_users, k) if m is None else m
    first = top_user(pool, "importance").first()
    seeds, members = [(0, first["user_id"], float(first["importance"]))], None
    while True:
        ordinal, seed, _ = seeds[-1]
        newest = pick_centroid(profile, _seed_frame(spark, seeds[-1:]))
        near = pool.join(distance_to_centroid(profile, newest, n_items), "user_id")
        scored = cut_lineage(near.select("user_id", "importance", "distance"))
        inside = up_to("distance", "user_id", nth_smallest(scored, "distance", "user_id", m))
        taken = scored.where(inside).select("user_id", F.lit(seed).alias("label"), F.lit(ordinal).alias("ordinal"))
        members = taken if members is None else members.unionByName(taken)
        pool = scored.where(~inside)
        if len(seeds) == k:
            break
        best = top_user(seed_score(pool, largest if f_scale == "global" else None), "score").first()
        if best is None:  # fewer users than seeds asked for
            break
        seeds.append((len(seeds), best["user_id"], best["score"]))
        pool = pool.select("user_id", "importance")
    frame = _seed_frame(spark, seeds)
    return Seeding(frame, pick_centroid(profile, frame), members)


def _seed_frame(spark, seeds) -> DataFrame:
    return spark.createDataFrame(seeds, "ordinal int, label bigint, score double")


def assign_clusters(profile: DataFrame, centroids: DataFrame, n_items: int | None = None) -> DataFrame:
    """Nearest centroid of every user, with the distance; the first centroid wins a tie."""
    users, heads = _placed(profile, centroids, n_items)
    return _named(users, heads, F.col("upper"))


def update_centroids(profile: DataFrame, assigned: DataFrame) -> DataFrame:
    """Mean profile of the users of each label."""
    labels = assigned.select("user_id", "label", "ordinal")
    if "slot" in profile.columns:
        # meet the stored profile on its own buckets: only user-sized tables move
        labels = _by_slot(profile.select("user_id", "slot").distinct().join(labels, "user_id"))
        joined = profile.join(labels, ["user_id", "slot"])
    else:
        joined = profile.join(labels, "user_id")
    sizes = assigned.groupBy("ordinal", "label").agg(F.count("*").alias("n"), F.avg("base").alias("base"))
    return (joined.groupBy("ordinal", "label", "item_id").agg(F.sum("dev").alias("dev"))
            .join(F.broadcast(sizes), ["ordinal", "label"])  # one row per centroid
            .select("ordinal", "label", "base", "item_id", (F.col("dev") / F.col("n")).alias("dev")))


@dataclass
class Rounds:
    """How many users each round of a refinement computed distances for, and how many changed cluster."""
    computed: list[int] = field(default_factory=list)
    moved: list[int] = field(default_factory=list)


def _of(profile: DataFrame, slots: DataFrame, users: DataFrame, few: bool) -> DataFrame:
    """The stored profile of some users together with their columns in `users`, without shuffling it."""
    if few:
        return profile.join(F.broadcast(users), "user_id")
    # Meet it on its own buckets: only user-sized tables move.
    return profile.join(_by_slot(slots.join(users, "user_id")), ["user_id", "slot"])


def _gap(n_items: int, a: Head, b: Head, dot: float) -> tuple[float, float]:
    """What the distance of two centroids is at least and at most, as their sums are rounded; `dot` sums the products of their deviations."""
    gap = a.base - b.base
    square = n_items * gap * gap + 2 * gap * (a.s - b.s) + a.q + b.q - 2 * dot
    error = 1e-13 * (n_items * gap * gap + abs(2 * gap * (a.s - b.s)) + a.q + b.q)
    return math.sqrt(max(0.0, square - error)), math.sqrt(max(0.0, square) + error)


def refine_clusters(profile: DataFrame, centroids: DataFrame, max_iter: int | None = None, n_items: int | None = None,
                    rounds: Rounds | None = None):
    """Assign and average in turn until no user changes cluster. Returns (assignment, centroids, number of rounds).

    `profile` comes from `prepare_profile`. A centroid left without users stays where it is. With `max_iter`, not being done
    by then is an error, and so is an assignment that comes back although users move: only rounding could
    cause that. `rounds` is filled with what each round did.
    """
    n_items = count_items(profile) if n_items is None else n_items
    rounds = rounds if rounds is not None else Rounds()
    heads = _heads(centroids)
    k, each = len(heads), range(len(heads))
    slots = store(profile.select("user_id", "slot").distinct(), "slots")
    allowance = Allowance(BROADCAST_TOTAL)
    few = lambda n: n <= BROADCAST_ROWS and allowance.take(3 * n)
    changed, columns = "at != was or was is null", ["user_id", "base", "was", "at", "upper", "lower"]

    def census(state):
        """Per cluster: users, sum of their means, how many were computed and how many came from elsewhere, a hash of who they are."""
        rows = state.groupBy("at").agg(F.count("*").alias("n"), F.sum("base").alias("base"), F.count_if("fresh").alias("fresh"),
                                       F.count_if(F.expr(changed)).alias("moved"), F.bit_xor(F.xxhash64("user_id")).alias("hash")).collect()
        rounds.computed.append(sum(r["fresh"] for r in rows))
        rounds.moved.append(sum(r["moved"] for r in rows))
        return {r["at"]: r for r in rows}

    # c0, c1, ... are the places of the centroids times their `n`. `sums` tells where the sums of their users' deviations stand: these are the places, too,
    # but of the given centroids (none yet) and of those without users (s0, s1, ...).
    wide, sums = store(_side_by_side(centroids, heads), "centroids"), ["0D"] * k
    state = _nearest(_products(profile, wide, k, allowance=allowance).withColumn("was", F.lit(None).cast("int")), heads, n_items)
    state = store(state.select(*columns, F.lit(True).alias("fresh")), "assignment")
    found, seen = census(state), set()
    done = 0
    while max_iter is None or done < max_iter:
        done += 1
        seen.add(tuple(sorted((at, r["n"], r["hash"]) for at, r in found.items())))
        # The centroids' new places: only users that moved change the sums.
        moved = _of(profile, slots, state.where(changed).select("user_id", "at", "was"), few(rounds.moved[-1]))
        moved = moved.groupBy("item_id").agg(*[F.expr(f"sum(dev * (if(at = {i}, 1, 0) - if(was <=> {i}, 1, 0)))").alias(f"t{i}") for i in each])
        # Beside the places stands what moved them, or the places before where these were no sums.
        by_sum = [i in found and sums[i] == f"coalesce(c{i}, 0D)" for i in each]
        total = [f"{sums[i]} + coalesce(t{i}, 0D)" for i in each]
        places = [f"{total[i] if i in found else f'coalesce(c{i}, 0D)'} as c{i}" for i in each]
        others = [f"{total[i]} as s{i}" for i in each if i not in found]
        earlier = [f"coalesce(t{i}, 0D) as d{i}" if by_sum[i] else f"coalesce(c{i}, 0D) as o{i}" for i in each if i in found]
        # The join leaves the items where their buckets are, so the next rounds move only what is new.
        kept = wide.select([c for c in wide.columns if c[0] not in "do"])
        wide = store_bucketed(kept.join(moved, "item_id", "full").selectExpr("item_id", *places, *others, *earlier), "centroids", "item_id", dealt=True)
        sums = [f"coalesce(c{i}, 0D)" if i in found else f"coalesce(s{i}, 0D)" for i in each]
        old = [f"c{i}" if i not in found else f"(c{i} - d{i})" if by_sum[i] else f"o{i}" for i in each]
        near = [(i, j) for i in each for j in range(i)] if k <= PAIRED else []
        told = wide.selectExpr(*[f"coalesce(sum(c{i}), 0D) as s{i}" for i in each], *[f"coalesce(sum(c{i} * c{i}), 0D) as q{i}" for i in each],
                               *[f"coalesce(sum(c{i} * {old[i]}), 0D) as dot{i}" for i in each],
                               *[f"coalesce(sum(c{i} * c{j}), 0D) as dot{i}_{j}" for i, j in near]).first()
        before = heads
        n = [float(found[i]["n"]) if i in found else h.n for i, h in enumerate(before)]
        heads = [Head(h.ordinal, h.label, found[i]["base"] / n[i] if i in found else h.base, told[f"s{i}"] / n[i], told[f"q{i}"] / n[i] ** 2, n[i])
                 for i, h in enumerate(before)]
        drift = [_gap(n_items, heads[i], before[i], told[f"dot{i}"] / (n[i] * before[i].n))[1] for i in each]
        half = [math.inf if near else 0.0] * k
        for i, j in near:
            apart = _gap(n_items, heads[i], heads[j], told[f"dot{i}_{j}"] / (n[i] * n[j]))[0] / 2
            half[i], half[j] = min(half[i], apart), min(half[j], apart)
        others = [max((d for j, d in enumerate(drift) if j != i), default=0.0) for i in each]
        state = state.selectExpr("user_id", "base", "at as was", "at", f"upper + get({_array(drift)}, at) as upper", f"lower - get({_array(others)}, at) as lower")
        meet = F.expr(f"upper + {_number(MARGIN)} >= greatest(lower, get({_array(half)}, at))")
        active = state.where(meet).select("user_id", "was")
        active = _of(profile, slots, active, few(active.count()))
        active = _nearest(_products(active, wide, k, ("was",), allowance), heads, n_items)
        state = store(state.where(~meet).select(*columns, F.lit(False).alias("fresh"))
                      .unionByName(active.select(*columns, F.lit(True).alias("fresh"))), "assignment")
        found = census(state)
        if not rounds.moved[-1]:
            exact = _products(profile, wide, k, allowance=allowance).join(state.select("user_id", "at"), "user_id")
            distance = F.get(F.expr(_distance_array(heads, n_items)), F.col("at"))["distance"]
            return cut_lineage(_named(exact, heads, distance)), _one_below_another(wide, heads), done
        if tuple(sorted((at, r["n"], r["hash"]) for at, r in found.items())) in seen:
            raise RuntimeError(f"after {done} rounds the assignment came back to an earlier one")
    raise RuntimeError(f"users still change clusters after {max_iter} rounds")


def _one_below_another(wide: DataFrame, heads: list[Head]) -> DataFrame:
    """(ordinal, label, base, item_id, dev) of centroids laid side by side."""
    each = F.explode(F.array(*[F.struct(F.lit(h.ordinal).alias("ordinal"), F.lit(h.label).cast("bigint").alias("label"), F.lit(float(h.base)).alias("base"),
                                        (F.col(f"c{i}") / h.n).alias("dev")) for i, h in enumerate(heads)]))
    return wide.select("item_id", each.alias("c")).where("c.dev != 0").select("c.ordinal", "c.label", "c.base", "item_id", "c.dev")


def seed_labels(seeding: Seeding, profile: DataFrame, n_items: int | None = None) -> DataFrame:
    """Discarded users keep the label of their seed; only the others go to the nearest centroid."""
    rest = assign_clusters(profile, seeding.centroids, n_items).select("user_id", "label", "ordinal")
    return seeding.members.unionByName(discard_users(rest, seeding.members))


def labels(assigned: DataFrame) -> DataFrame:
    return assigned.select("user_id", "label")


def label_ratings(ratings: DataFrame, user_labels: DataFrame) -> DataFrame:
    return ratings.join(user_labels.select("user_id", "label"), "user_id")


def cluster_model(ratings: DataFrame, k: int = 5, refine: bool = True, max_iter: int | None = None, f_scale: str = "global",
                  m: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(user_id, label) end to end, and the centroids: refined, or the seeds with their own users labelled directly."""
    profile = prepare_profile(ratings, k=k)
    n_items = count_items(profile)
    seeding = seed_centroids(profile, importance(ratings), k, f_scale, m, n_items)
    if not refine:
        return labels(seed_labels(seeding, profile, n_items)), seeding.centroids
    assigned, centroids, _ = refine_clusters(profile, seeding.centroids, max_iter, n_items)
    return labels(assigned), centroids


def cluster_users(ratings: DataFrame, k: int = 5, refine: bool = True, max_iter: int | None = None, f_scale: str = "global",
                  m: int | None = None) -> DataFrame:
    """The labels of `cluster_model`."""
    return cluster_model(ratings, k, refine, max_iter, f_scale, m)[0]
