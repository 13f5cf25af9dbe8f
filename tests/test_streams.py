import pytest

from brute import factors
from kindred import schemas
from kindred.operators import similarity
from kindred.streaming import streams


def feed(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, df.schema)


def rows(spark, *data):
    return spark.createDataFrame([(u, i, float(r), t) for u, i, r, t in data], schemas.RATINGS)


def test_late_ratings_stay_and_repeated_ones_count_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = rows(spark, (1, 1, 5, 100_000), (1, 1, 5, 100_000), (2, 1, 3, 99_000))
    streams.stream_ratings(feed(spark, first, source), sink, state).awaitTermination()
    second = rows(spark, (3, 1, 4, 97_000), (1, 1, 5, 100_000), (4, 1, 4, 92_000))
    streams.stream_ratings(feed(spark, second, source), sink, state).awaitTermination()
    stored = sorted((r.user_id, r.ts) for r in streams.stored_ratings(spark, sink).collect())
    assert stored == [(1, 100_000), (2, 99_000), (3, 97_000), (4, 92_000)]
    assert spark.read.parquet(sink).select("batch").distinct().count() >= 2
    assert spark.read.parquet(sink).count() == 4  # repeats are not even stored


def test_running_user_stats(spark, tmp_path, many):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (many.where("ts < 1000000"), many.where("ts >= 1000000")):
        streams.stream_user_stats(feed(spark, part, source), sink, state).awaitTermination()
    from kindred.operators.ratings import avg_rating, importance
    found = {r.user_id: (r.avg_rating, r.importance) for r in streams.latest_user_stats(spark, sink).collect()}
    expected = {r.user_id: (r.avg_rating, r.importance) for r in avg_rating(many).join(importance(many), "user_id").collect()}
    assert found.keys() == expected.keys()
    for user, value in expected.items():
        assert found[user] == pytest.approx(value)


def test_similarity_follows_the_stream(spark, tmp_path, many):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [many.where("ts <= 2000000"), many.where("ts > 2000000 and ts <= 2500000"), many.where("ts > 2500000")]
    base = similarity.mfps(parts[0])
    for part in (parts[2], parts[1]):  # the later ratings first
        part.coalesce(1).write.mode("append").parquet(source)
    stream = streams.read_stream(spark, source, schemas.RATINGS, files_per_batch=1)
    streams.stream_similarity(stream, parts[0], base, sink, state).awaitTermination()
    assert spark.read.parquet(f"{sink}/changed").select("batch").distinct().count() >= 2
    found = {(r.user_u, r.user_v): r.mfps for r in streams.current_similarity(spark, sink).collect()}
    assert found == pytest.approx({p: v[4] for p, v in factors(many.collect()).items()})


def test_closed_sessions_and_the_newest_of_them(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    hours = [0, 1, 10, 20, 30, 40, 41, 60]
    data = spark.createDataFrame([(1, 0 if h % 2 else 1, h * 3600) for h in hours], "user_id long, action int, s long")
    data = data.selectExpr("user_id", "action", "timestamp_seconds(s) as event_time")
    for part in (data.where("event_time < timestamp_seconds(20 * 3600)"), data.where("event_time >= timestamp_seconds(20 * 3600)")):
        streams.stream_recent_sessions(feed(spark, part, source), sink, state).awaitTermination()
    found = sorted((r.created_at // 3_600_000_000, r.n_actions) for r in streams.latest_sessions(spark, sink).collect())
    assert found == [(10, 1), (20, 1), (30, 1), (40, 2)]  # hour 0 is the fifth, hour 60 is still open


def test_a_batch_writes_only_users_whose_sessions_closed(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [[(u, h) for u in range(20) for h in (0, 10)], [(3, 30), (3, 31), (4, 32)], [(50, 60)], [(51, 24 * 400)], [(3, 24 * 500), (52, 24 * 510)]]
    for part in parts:
        data = spark.createDataFrame([(u, 1, h * 3600) for u, h in part], "user_id long, action int, s long")
        data = data.selectExpr("user_id", "action", "timestamp_seconds(s) as event_time")
        streams.stream_recent_sessions(feed(spark, data, source), sink, state, n=2, idle_days=365).awaitTermination()
    written = {}
    for r in spark.read.parquet(sink).collect():
        written.setdefault(r.batch, {}).setdefault(r.user_id, []).append(r.created_at // 3_600_000_000)
    lists = [{u: sorted(hours) for u, hours in written[b].items()} for b in sorted(written)]
    assert {3: [10, 30], 4: [10, 32]} in lists
    assert sum(len(b) for b in lists if 10 in b) <= 40  # user 10 is not written again with users 3 and 4
    # User 3 was forgotten after a year without sessions and starts anew.
    assert [b[3] for b in lists if 3 in b][-1] == [24 * 500]
    assert sorted(r.created_at // 3_600_000_000 for r in streams.latest_sessions(spark, sink).where("user_id = 4").collect()) == [10, 32]
