import random

import pytest
from pyspark.sql import functions as F

from brute import dense, distance
from kindred.operators import clustering
from kindred.operators.ratings import importance
from kindred.operators.selection import nth_smallest, up_to


def test_known_seeds_and_labels(ratings):
    profile = clustering.prepare_profile(ratings)
    seeding = clustering.seed_centroids(profile, importance(ratings), k=2)
    assert [r.label for r in seeding.seeds.orderBy("ordinal").collect()] == [22, 166]
    assert seeding.seeds.where("ordinal = 1").first().score == pytest.approx(1.539360, rel=1e-6)
    first = {r.user_id for r in seeding.members.where("label = 22").collect()}
    assert first == {22, 186}
    assigned, _, _ = clustering.refine_clusters(profile, seeding.centroids)
    assert {r.user_id: r.label for r in assigned.collect()} == {6: 22, 22: 22, 253: 22, 166: 166, 186: 166}
    direct = {r.user_id: r.label for r in clustering.seed_labels(seeding, profile).collect()}
    assert direct[186] == 22 and len(direct) == 5


def test_sparse_distance_equals_dense(many, monkeypatch):
    monkeypatch.setattr(clustering, "SLOT_ROWS", 5)  # cut users into slots
    profile = clustering.prepare_profile(many)
    assert profile.select("slot").distinct().count() > 1
    vectors = dense(many.collect())
    seeds = clustering._seed_frame(many.sparkSession, [(0, 3, 1.0)])
    found = clustering.distance_to_centroid(profile, clustering.pick_centroid(profile, seeds)).collect()
    for r in found:
        assert r.distance == pytest.approx(distance(vectors[r.user_id], vectors[3]), abs=1e-5)


def test_refinement_equals_dense_rounds(many, monkeypatch):
    monkeypatch.setattr(clustering, "SLOT_ROWS", 5)
    profile = clustering.prepare_profile(many)
    vectors = dense(many.collect())
    centroids = {0: vectors[1], 1: vectors[2], 2: vectors[3]}
    start = clustering.pick_centroid(profile, clustering._seed_frame(many.sparkSession, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]))
    cost, before = [], None
    while True:
        label = {u: min(centroids, key=lambda c: (distance(v, centroids[c]), c)) for u, v in vectors.items()}
        if label == before:
            break
        before = label
        cost.append(sum(distance(v, centroids[label[u]]) ** 2 for u, v in vectors.items()))
        for c in centroids:
            mine = [vectors[u] for u in vectors if label[u] == c]
            centroids[c] = [sum(x) / len(mine) for x in zip(*mine)]
    assigned, _, rounds = clustering.refine_clusters(profile, start)
    assert rounds == len(cost) > 1
    with pytest.raises(RuntimeError):
        clustering.refine_clusters(profile, start, max_iter=1)
    assert {r.user_id: r.ordinal for r in assigned.collect()} == label
    assert cost == sorted(cost, reverse=True)


def test_rounds_do_not_shuffle_the_profile(spark, many):
    profile = clustering.prepare_profile(many)
    seeds = clustering._seed_frame(spark, [(0, 1, 1.0), (1, 2, 1.0)])
    assigned = clustering.assign_clusters(profile, clustering.pick_centroid(profile, seeds), 80)
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and ", slot" not in "".join(
        line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assigned = clustering.cut_lineage(assigned)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clustering.update_centroids(profile, assigned)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_slot = [line for line in plan.splitlines() if "Exchange hashpartitioning(user_id" in line and "slot" in line]
    assert len(by_slot) == 1 and "REPARTITION_BY_NUM" in by_slot[0]  # the labels, not the profile


def test_empty_cluster_keeps_its_centroid(spark, ratings):
    profile = clustering.prepare_profile(ratings)
    near = clustering.pick_centroid(profile, clustering._seed_frame(spark, [(0, 22, 1.0)]))
    far = spark.createDataFrame([(1, 99, 100.0, 86, 0.5)], near.schema)
    assigned, centroids, _ = clustering.refine_clusters(profile, near.unionByName(far))
    assert {r.ordinal for r in assigned.collect()} == {0}
    assert [tuple(r) for r in centroids.where("ordinal = 1").collect()] == [(1, 99, 100.0, 86, 0.5)]


def test_first_of_equal_centroids_wins(spark, ratings):
    profile = clustering.prepare_profile(ratings)
    twice = clustering.pick_centroid(profile, clustering._seed_frame(spark, [(0, 22, 1.0), (1, 22, 1.0)]))
    assert {r.ordinal for r in clustering.assign_clusters(profile, twice).collect()} == {0}


def test_more_seeds_than_users(ratings):
    profile = clustering.prepare_profile(ratings)
    seeding = clustering.seed_centroids(profile, importance(ratings), k=9)
    assert seeding.seeds.count() <= 5 and seeding.seeds.select("label").distinct().count() == seeding.seeds.count()


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "half"])
def test_nth_smallest_without_sorting_everything(spark, kind):
    rng = random.Random(3)
    value = {"spread": lambda i: rng.random(), "ties": lambda i: 1.0, "few": lambda i: float(rng.randint(0, 3)),
             "half": lambda i: 5.0 if i % 2 else rng.random() * 10}[kind]
    rows = [(i, value(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, d double").cache()
    expected = sorted((d, i) for i, d in rows)
    for n in (1, 7, 1500, 2999, 3000):
        cut = nth_smallest(df, "d", "user_id", n, sorted_rows=50)
        assert cut == expected[n - 1]
        assert df.where(up_to("d", "user_id", cut)).count() == n
    assert nth_smallest(df, "d", "user_id", 3001) is None


def _starts(spark):
    return clustering._seed_frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)])


def _all_rounds(profile, start):
    """Refinement that computes every user in every round."""
    assigned = clustering.cut_lineage(clustering.assign_clusters(profile, start))
    while True:
        moved = clustering.update_centroids(profile, assigned)
        start = clustering.cut_lineage(moved.unionByName(start.join(moved.select("ordinal").distinct(), "ordinal", "left_anti")))
        before = {r.user_id: r.ordinal for r in assigned.collect()}
        assigned = clustering.cut_lineage(clustering.assign_clusters(profile, start))
        if before == {r.user_id: r.ordinal for r in assigned.collect()}:
            return assigned, start


@pytest.fixture(scope="module")
def spread(spark):
    """900 users in six groups of taste."""
    from kindred import schemas
    rng, rows = random.Random(11), []
    for u in range(900):
        for i in rng.sample(range(60), rng.randint(3, 15)):
            liked = i % 6 == u % 6
            rows.append((u, i, float(min(5, max(1, rng.gauss(4.3 if liked else 2.2, 0.7)))), rng.randint(0, 10**6)))
    return spark.createDataFrame(rows, schemas.RATINGS).cache()


@pytest.fixture(scope="module")
def refined(spark, spread):
    profile = clustering.prepare_profile(spread)
    start = clustering.cut_lineage(clustering.pick_centroid(profile, _starts(spark)))
    return profile, start, *_all_rounds(profile, start)


@pytest.mark.parametrize("few", [500_000, 0])
def test_bounds_spare_users_and_change_nothing(refined, monkeypatch, few):
    monkeypatch.setattr(clustering, "BROADCAST_ROWS", few)
    profile, start, want, places = refined
    rounds = clustering.Rounds()
    assigned, centroids, done = clustering.refine_clusters(profile, start, rounds=rounds)
    got = {r.user_id: (r.ordinal, r.label) for r in assigned.collect()}
    assert got == {r.user_id: (r.ordinal, r.label) for r in want.collect()}
    near = {r.user_id: r.distance for r in want.collect()}
    assert all(r.distance == pytest.approx(near[r.user_id], abs=1e-7) for r in assigned.collect())
    values = lambda df: {(r.ordinal, r.item_id): (r.base, r.dev) for r in df.collect() if abs(r.dev) > 1e-9}
    found, expected = values(centroids), values(places)
    assert found.keys() == expected.keys() and all(found[c] == pytest.approx(expected[c], abs=1e-9) for c in found)
    assert len(rounds.computed) == done + 1 > 5 and rounds.moved[-1] == 0
    assert sum(rounds.computed[-4:]) < 900 < sum(rounds.computed) < 900 * (done + 1) * 0.7


def test_centroids_above_the_bound_are_broadcast_range_by_range(spark, many, monkeypatch):
    seeds = _starts(spark)
    plain = clustering.prepare_profile(many)
    want = {r.user_id: r.ordinal for r in clustering.refine_clusters(plain, clustering.pick_centroid(plain, seeds))[0].collect()}
    monkeypatch.setattr(clustering, "BROADCAST_CELLS", 120)
    monkeypatch.setattr(clustering, "SLOT_ROWS", 5)
    profile = clustering.prepare_profile(many, k=4)
    assert profile.select("range").distinct().count() == 4 and profile.count() == many.count()
    plans, kept = [], clustering.store
    monkeypatch.setattr(clustering, "store", lambda df, name: plans.append(
        (name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = clustering.refine_clusters(profile, clustering.pick_centroid(profile, seeds))[0]
        assert {r.user_id: r.ordinal for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    products = [plan for name, plan in plans if name == "products"]
    assert len(products) >= 8
    for plan in products:
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan and "PartitionFilters: [isnotnull(range" in plan


def test_a_returning_assignment_is_an_error(spark, many, monkeypatch):
    profile = clustering.prepare_profile(many)
    start, plain, calls = clustering.pick_centroid(profile, _starts(spark)), clustering._nearest, []

    def restless(users, heads, n_items):
        calls.append(1)
        return plain(users, heads, n_items).withColumns({"at": F.lit(len(calls) % 2), "upper": F.lit(1.0), "lower": F.lit(0.0)})
    monkeypatch.setattr(clustering, "_nearest", restless)
    with pytest.raises(RuntimeError, match="came back"):
        clustering.refine_clusters(profile, start)


@pytest.mark.parametrize("total", [0, 2_000])
def test_rounds_send_no_more_through_the_driver_than_allowed(spark, refined, monkeypatch, total):
    profile, start, want, places = refined
    monkeypatch.setattr(clustering, "BROADCAST_TOTAL", total)
    cells, plain = [], F.broadcast

    def counted(df):
        cells.append(df.count() * (5 if "c0" in df.columns else 3))
        return plain(df)
    monkeypatch.setattr(clustering.F, "broadcast", counted)
    assigned, centroids, done = clustering.refine_clusters(profile, start)
    assert done > 5 and sum(cells) <= total
    near = {r.user_id: (r.ordinal, pytest.approx(r.distance, abs=1e-7)) for r in want.collect()}
    assert {r.user_id: (r.ordinal, r.distance) for r in assigned.collect()} == near
    values = lambda df: {(r.ordinal, r.item_id): (r.base, r.dev) for r in df.collect() if abs(r.dev) > 1e-9}
    found, expected = values(centroids), values(places)
    assert found.keys() == expected.keys() and all(found[c] == pytest.approx(expected[c], abs=1e-9) for c in found)
