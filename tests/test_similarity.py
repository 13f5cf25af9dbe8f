import pytest
from pyspark.sql import functions as F

from brute import factors
from kindred import schemas
from kindred.operators import incremental, pairs, similarity
from kindred.session import folders_made


def scored(df):
    return {(r.user_u, r.user_v): (r.rc, r.ru, r.rd, r.rt, r.mfps) for r in df.collect()}


def same(found, expected):
    assert found.keys() == expected.keys()
    for pair, values in expected.items():
        assert found[pair] == pytest.approx(values, rel=1e-9), pair


def test_known_scores(ratings):
    found = scored(similarity.mfps(ratings))
    assert found.keys() == {(6, 22), (22, 6), (22, 166), (166, 22)}
    assert found[6, 22] == pytest.approx((1, 2, 1, 0.095172523, 0.071391681), rel=1e-6)
    assert found[22, 6] == pytest.approx((1, 0, 1, 0.095172523, 0.074034401), rel=1e-6)
    assert found[22, 166] == pytest.approx((2, 1, 1, 0.211014435, 0.121373772), rel=1e-6)
    strict = scored(similarity.mfps(ratings, strict=True))
    assert strict[166, 22][4] == pytest.approx(0.138140393, rel=1e-6)


@pytest.mark.parametrize("way", ["join", "grid", "auto", "lists"])
@pytest.mark.parametrize("strict", [False, True])
def test_both_ways_equal_brute_force(many, way, strict):
    same(scored(similarity.mfps(many, way=way, strict=strict)), factors(many.collect(), strict))


def test_small_chunks_and_hot_item_meet_every_pair_once(many):
    users = many.where("item_id = 0").count()
    met, _ = pairs.rater_pairs(many.where("item_id = 0"), ["rating"], way="join", chunk=7)
    rows = met.select("u", "v").collect()
    assert len(rows) == len(set(rows)) == users * (users - 1) // 2
    assert all(r.u < r.v for r in rows)
    cells = met.groupBy("low", "high").count().agg(F.max("count")).first()[0]
    assert cells < len(rows) / 20  # no task sees the whole item


def test_pairs_stay_inside_their_cluster(many):
    labelled = many.withColumn("label", F.col("user_id") % 3)
    expected = {}
    for label in range(3):
        expected.update(factors(labelled.where(F.col("label") == label).collect()))
    for way in ("join", "grid"):
        same(scored(similarity.mfps(labelled, within="label", way=way)), expected)


def test_grid_aggregates_without_moving_pair_rows(many):
    plan = similarity.pair_factors(many, way="grid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Python" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("sizes", [{}, {"chunk": 7}, {"chunk": 7, "task_pairs": 300}])
def test_lists_meet_every_pair_once(many, sizes):
    met, local = pairs.rater_pairs(many, ["rating", "ts"], way="lists", **sizes)
    raters = {}
    for r in many.collect():
        raters.setdefault(r.item_id, []).append((r.user_id, r.rating, r.ts))
    expected = {(*a, *b, i) for i, who in raters.items() for a in who for b in who if a[0] < b[0]}
    rows = [tuple(r) for r in met.select("u", "u_rating", "u_ts", "v", "v_rating", "v_ts", "item_id").collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    if "task_pairs" in sizes:  # a busy user's pairs lie in several parts, each pair in one
        assert local == ["part"] and met.select("part").distinct().count() > 1
        assert met.groupBy("u", "v").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("spread, kinds", [(1, ["smallint"]), (4, ["smallint", "tinyint"]), (400, ["int"]), (10 ** 5, ["int", "tinyint"]), (10 ** 7, ["int", "smallint"]),
                                           (10 ** 10, ["int", "smallint", "tinyint"]), (10 ** 12, ["int", "int"])])
def test_integers_travel_as_one_narrow_number(spark, spread, kinds):
    rows = [(u, -3 + u % 5 if u % 7 else None, (u % 11 - 5) * 86_400 if u % 3 else None, 5 - u * spread) for u in range(60)] + [(60, 1, 0, None)]
    frame = spark.createDataFrame(rows, "user_id long, side int, day long, far long").drop(*(["far"] if spread == 1 else []))
    code = pairs._code(pairs._ends(frame, frame.columns))
    assert code.kinds == kinds
    moved = frame.select("*", *code.words({c: F.col(c) for c in code.at})).repartition(3)
    assert [dict(moved.dtypes)[f"w{i}"] for i in range(len(kinds))] == kinds
    back = moved.select(*[c.alias(n) for n, c in code.values(dict(zip(frame.columns, [f.dataType for f in frame.schema]))).items()])
    assert back.schema["side"].dataType == frame.schema["side"].dataType
    assert sorted(map(str, back.select(*frame.columns).collect())) == sorted(map(str, frame.collect()))
    wide = spark.createDataFrame([(0, -2 ** 63, 2 ** 63 - 1), (1, 2 ** 63 - 1, 0)], "user_id long, side long, far long")
    assert pairs._code(pairs._ends(wide, wide.columns)) is None


def test_lists_without_a_common_number_meet_every_pair(spark, many):
    far = many.withColumn("ts", F.when(F.col("user_id") % 2 == 0, F.col("ts") + 2 ** 62).otherwise(F.col("ts") - 2 ** 62 - 2 ** 61))
    met, _ = pairs.rater_pairs(far, ["rating", "ts"], way="lists")
    joined, _ = pairs.rater_pairs(far, ["rating", "ts"], way="join")
    columns = ["u", "v", "item_id", "u_rating", "v_rating", "u_ts", "v_ts"]
    assert sorted(map(tuple, met.select(*columns).collect())) == sorted(map(tuple, joined.select(*columns).collect()))


def test_lists_are_the_only_pair_rows_that_move(many):
    plan = similarity.pair_factors(many, way="lists")._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate inline")]
    assert "Exchange" not in above and "HashAggregate" in above


def test_changed_raters_aggregate_where_they_meet(many):
    some = many.where("user_id < 40")
    marked = many.withColumn("mine", F.col("user_id") < 40)
    met, local = pairs.listed_with(some, marked, ["item_id"], ["ts"], chunk=7, task_pairs=300, once="mine")
    found = met.groupBy(*local, "u", "v").agg(F.count("*").alias("n"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate inline")]
    expected = {p: v[0] for p, v in factors(many.collect()).items() if p[0] < 40 and (p[1] >= 40 or p[0] < p[1])}
    rows = found.collect()
    assert {(r.u, r.v): r.n for r in rows} == expected and len(rows) == len(expected)


def test_corated_pairs(ratings):
    found = similarity.corated_pairs(ratings).collect()
    assert {(r.user_u, r.user_v, r.item_id) for r in found} == {(6, 22, 86), (22, 166, 346), (22, 166, 377)}
    assert all(r.rating_u in (3.0, 4.0, 1.0) for r in found)


def test_single_factors_agree_with_the_score(many):
    expected = factors(many.collect())
    for at, frame in enumerate([similarity.rating_commodity(many), similarity.rating_usefulness(many),
                                similarity.rating_details(many), similarity.rating_time(many)]):
        found = {(r[0], r[1]): r[2] for r in frame.collect()}
        assert found == pytest.approx({p: v[at] for p, v in expected.items()})


def test_ratings_meet_their_users_only_for_what_is_asked(many, monkeypatch):
    met = []
    monkeypatch.setattr(similarity, "with_sides", lambda *a, f=similarity.with_sides: met.append(1) or f(*a))
    expected = factors(many.collect())
    for frame, at in ((similarity.rating_commodity(many), 0), (similarity.rating_time(many), 3)):
        assert not met
        assert {(r[0], r[1]): r[2] for r in frame.collect()} == pytest.approx({p: v[at] for p, v in expected.items()})
    similarity.rating_usefulness(many), similarity.rating_details(many)
    assert len(met) == 2
    known = many.where("user_id < 40").groupBy("user_id").agg(F.avg("rating").alias("avg_rating"))
    some = {(r.user_u, r.user_v) for r in similarity.rating_commodity(many, averages=known).collect()}
    assert some == {p for p in expected if max(p) < 40}


def test_strangers(spark, ratings):
    scores = similarity.mfps(ratings)
    wanted = spark.createDataFrame([(6, 166), (6, 22)], "user_u long, user_v long")
    get = lambda df: {(r.user_u, r.user_v): r.mfps for r in df.collect()}
    assert get(similarity.similarity_of(wanted, scores, ratings, "skip"))[6, 166] == pytest.approx(0.75)
    assert get(similarity.similarity_of(wanted, scores, zero_rc="zero"))[6, 166] == 0.0
    assert (6, 166) not in get(similarity.similarity_of(wanted, scores, zero_rc="drop"))


def test_neighbours_are_ranked_and_cut(many):
    top = similarity.neighbours(similarity.mfps(many), 5)
    expected = factors(many.collect())
    mine = sorted(((-v[4], p[1]) for p, v in expected.items() if p[0] == 3))[:5]
    got = sorted((r["rank"], r.user_v) for r in top.where("user_u = 3").collect())
    assert [v for _, v in got] == [v for _, v in mine]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_incremental_equals_recompute(spark, many):
    old = many.where("ts <= 2000000")
    changed = incremental.changed_users(many.where("ts > 2000000")).where("user_id < 60")
    now = old.unionByName(many.where("ts > 2000000").join(changed, "user_id", "left_semi"))
    fresh = incremental.mfps_incremental(now, changed)
    merged = incremental.merge_similarity(similarity.mfps(old), fresh, changed)
    found = {(r.user_u, r.user_v): r.mfps for r in merged.collect()}
    assert found == pytest.approx({p: v[4] for p, v in factors(now.collect()).items()})


def test_merge_shuffles_no_stored_scores(spark, many):
    stored = similarity.mfps(many, way="grid").select("user_u", "user_v", "mfps")
    changed = many.where("user_id < 10").select("user_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = incremental.merge_similarity(stored, stored.where("user_u < 10 or user_v < 10"), changed)
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin [user_u") == plan.count("BroadcastHashJoin [user_v") == 1
    assert merged.count() == stored.count()


def test_pairs_with_small_chunks(many):
    some = many.where("user_id < 40")
    rows = pairs.pairs_with(some, many, ["item_id"], ["rating"], chunk=5).select("u", "v", "item_id").collect()
    raters = {}
    for r in many.collect():
        raters.setdefault(r.item_id, []).append(r.user_id)
    expected = {(u, v, i) for i, who in raters.items() for u in who if u < 40 for v in who if u != v}
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def test_new_ratings_and_clusters(spark, ratings):
    stored, reviews = ratings.where("ts < 884000000"), ratings
    fresh = incremental.new_ratings(reviews, stored)
    assert fresh.count() == ratings.where("ts > 883603013").count()
    assert incremental.append_new_ratings(stored, reviews).count() == 10
    assert incremental.new_ratings(reviews, schemas.empty(spark, schemas.RATINGS)).count() == 10
    labels = spark.createDataFrame([(22, 1), (186, 2), (6, 3)], schemas.LABELS)
    found = incremental.affected_clusters(incremental.changed_users(fresh), labels)
    assert {r.label for r in found.collect()} == {1, 2}


@pytest.mark.parametrize("unit", [86_400, 1])
def test_whole_days_travel_as_days_and_counts_only_where_asked(spark, many, unit):
    from kindred.operators import pairs
    ratings = many.withColumn("ts", (F.floor(F.col("ts") / 3600) * unit - 50 * unit).cast("bigint")).cache()
    lists = similarity.pair_factors(ratings, way="lists").cache()
    plain = similarity.pair_factors(ratings, way="join")
    key = lambda r: (r.user_u, r.user_v)
    found = {key(r): (r.rc, r.rd, round(r.rt, 9), r.n_u, r.n_v) for r in lists.collect()}
    assert found == {key(r): (r.rc, r.rd, round(r.rt, 9), r.n_u, r.n_v) for r in plain.collect()}
    met, _, types = pairs._lists(ratings, ratings, ["item_id"], [], ["ts"], lambda v, user: v["v"] > user, 120)
    assert types["ts"] == (("smallint", 86_400) if unit == 86_400 else ("smallint", 1)) and types["user_id"] == ("tinyint", 1)
    assert dict(met.dtypes)["v_ts"] == "array<smallint>"
    bare = similarity.pair_factors(ratings, factors=("rd",), way="lists", counts=False)
    assert bare.columns == ["user_u", "user_v", "rd"]
    assert {key(r): r.rd for r in bare.collect()} == {k: v[1] for k, v in found.items()}


def test_pairs_not_asked_for_leave_before_the_shuffle(spark, ratings):
    scores = similarity.mfps(ratings)
    wanted = spark.createDataFrame([(22, 186), (166, 186), (6, 253)], "user_u long, user_v long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = similarity.similarity_of(wanted, scores, zero_rc="drop")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2 and "LeftSemi" in plan
        rows = {(r.user_u, r.user_v): r.mfps for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {(r.user_u, r.user_v): r.mfps for r in scores.collect() if (r.user_u, r.user_v) in {(22, 186), (166, 186), (6, 253)}}


@pytest.mark.parametrize("grid", [False, True])
def test_scores_lie_by_the_home_of_their_user(spark, many, monkeypatch, grid):
    monkeypatch.setattr(pairs, "grid_blocks", lambda session: 4 if grid else 1000)
    want = sorted((r.user_u, r.user_v, r.rc, r.ru, r.rd, round(r.rt, 9), round(r.mfps, 9)) for r in similarity.mfps(many).collect())
    found = similarity.mfps_by_user(many, 16)
    assert sorted((r.user_u, r.user_v, r.rc, r.ru, r.rd, round(r.rt, 9), round(r.mfps, 9)) for r in found.collect()) == want
    lies = found.select(F.pmod(F.xxhash64("user_u"), F.lit(16)).alias("home"), F.spark_partition_id().alias("task")).distinct().collect()
    assert len(lies) == len({r.home for r in lies}) > 8


def test_kept_factors_are_a_row_per_pair(spark, many):
    before = set(folders_made())
    kept = similarity.mfps(many, keep="factors")
    folder, = (f for f in folders_made() if f not in before and "/factors-" in f)
    assert kept.count() == similarity.mfps(many).count() == 2 * spark.read.parquet(folder).count()
