import pytest
from pyspark.sql import functions as F

from kindred import schemas
from kindred.operators import ratings as rt
from kindred.sources import stores, text


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_means_importance_and_top_user(ratings):
    assert as_dict(rt.avg_rating(ratings)) == pytest.approx({6: 3.0, 22: 8 / 3, 166: 2.0, 186: 2.5, 253: 5.0})
    assert as_dict(rt.importance(ratings)) == {6: 2, 22: 6, 166: 6, 186: 4, 253: 2}
    assert rt.top_user(rt.importance(ratings), "importance").first()["user_id"] == 22


def test_top_user_compares_numbers_not_text(spark):
    values = spark.createDataFrame([(1, 9.0), (2, 10.0)], "user_id long, value double")
    assert rt.top_user(values, "value").first()["user_id"] == 2


def test_max_scale(spark):
    values = spark.createDataFrame([(1, 2.0), (2, 8.0)], "user_id long, value double")
    assert {r["user_id"]: r["scaled"] for r in rt.max_scale(values, "value").collect()} == {1: 0.25, 2: 1.0}


def test_dedupe_keeps_latest_then_highest(spark):
    rows = [(1, 1, 2.0, 10), (1, 1, 5.0, 9), (1, 1, 3.0, 10), (1, 2, 1.0, 1)]
    kept = rt.dedupe_ratings(spark.createDataFrame(rows, schemas.RATINGS)).collect()
    assert {tuple(r) for r in kept} == {(1, 1, 3.0, 10), (1, 2, 1.0, 1)}


def test_dedupe_merges_copies_before_the_shuffle(spark):
    plan = rt.dedupe_ratings(spark.createDataFrame([], schemas.RATINGS))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_dense_matrix_fills_with_the_mean(ratings):
    cells = rt.dense_matrix(ratings, block_width=100).select("user_id", F.inline("cells")).collect()
    found = {(r["user_id"], r["item_id"]): r["value"] for r in cells}
    assert len(found) == 5 * 7
    assert found[22, 377] == 1.0 and found[22, 302] == pytest.approx(8 / 3) and found[253, 51] == 5.0


def test_text_round_trips(spark, ratings, tmp_path):
    text.write_ratings_kv(ratings, str(tmp_path / "kv"))
    assert set(text.read_ratings_kv(spark, str(tmp_path / "kv")).collect()) == set(ratings.collect())
    labels = spark.createDataFrame([(u, 7) for u in (6, 22, 166, 186, 253)], schemas.LABELS)
    text.write_packed_matrix(rt.dense_matrix(ratings), str(tmp_path / "m"), labels)
    back = text.read_packed_matrix(spark, str(tmp_path / "m"))
    assert back.count() == 35 and back.select("label").distinct().collect()[0][0] == 7
    text.write_packed_matrix(rt.dense_matrix(ratings), str(tmp_path / "plain"))
    assert text.read_packed_matrix(spark, str(tmp_path / "plain")).where("label is null").count() == 35


def test_packed_lines_are_small_and_read_once(spark, many, tmp_path):
    import os
    path, labels = str(tmp_path / "m"), many.select("user_id", (F.col("user_id") % 3).alias("label")).distinct()
    text.write_packed_matrix(rt.dense_matrix(many, block_width=10), path, labels)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
    back = text.read_packed_matrix(spark, path)
    cells = rt.dense_matrix(many, block_width=10).select("user_id", (F.col("user_id") % 3).alias("label"), F.inline("cells"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    # A line's label is taken from the line, not from the line again for each of its cells.
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan[:plan.index("Generate")] and "try_cast" not in plan[:plan.index("Generate")]


def test_clusters_and_neighbours_are_read_back(spark, ratings, tmp_path):
    labels = spark.createDataFrame([(6, 22), (22, 22), (253, 22), (166, 166), (186, 166)], schemas.LABELS)
    stores.write_clusters(ratings, labels, str(tmp_path / "c"))
    back = stores.read_clusters(spark, str(tmp_path / "c"))
    assert back.where("label = 22").count() == 5 and back.where("label = 166").count() == 5
    scores = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.4), (1, 3, 0.7)], schemas.SIMILARITY)
    stores.write_neighbours(scores, str(tmp_path / "n"))
    one = stores.read_neighbours(spark, str(tmp_path / "n"), user=1)
    assert {tuple(r) for r in one.collect()} == {(1, 2, 0.5), (1, 3, 0.7)}
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_conform_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="rating"):
        schemas.conform(spark.createDataFrame([(1, 2, 3)], "user_id long, item_id long, ts long"), schemas.RATINGS)


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    path = tmp_path / "kv"
    path.mkdir()
    (path / "part").write_text("1;2\t5;100\nx;2\t5;100\n1\t5;100\n1;3\t4\n2;2\t3.5;7\n")
    assert sorted(map(tuple, text.read_ratings_kv(spark, str(path)).collect())) == [(1, 2, 5.0, 100), (2, 2, 3.5, 7)]
    assert text.malformed_ratings_kv(spark, str(path)).count() == 3


def test_dense_matrix_shuffles_no_cells(many):
    cells = rt.dense_matrix(many, block_width=10).select("user_id", "block", F.inline("cells"))
    sums = cells.groupBy("user_id", "block").agg(F.sum("value").alias("total"))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("BroadcastHashJoin [block")]
    per_user = {(r.user_id): r.total for r in many.groupBy("user_id").agg(F.sum("rating").alias("total")).collect()}
    counts = {r.user_id: (r.n, r.mean) for r in many.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean")).collect()}
    items = many.select("item_id").distinct().count()
    found = {r.user_id: r.total for r in sums.groupBy("user_id").agg(F.sum("total").alias("total")).collect()}
    for user, (n, mean) in counts.items():
        assert abs(found[user] - per_user[user] - (items - n) * mean) < 1e-6


@pytest.mark.parametrize("size", [1000, 300])
def test_dense_matrix_has_tasks_for_its_cells(spark, many, size):
    items = many.select("item_id").distinct().count()
    matrix = rt.dense_matrix(many, block_width=10, task_cells=size)
    tasks = matrix.select(F.spark_partition_id().alias("task"), F.size("cells").alias("n")).groupBy("task").agg(F.sum("n").alias("n")).collect()
    assert -(-120 * items // size) * 0.6 < len(tasks) <= -(-120 * items // size) and sum(r.n for r in tasks) == 120 * items
    ratings = {(r.user_id, r.item_id): r.rating for r in many.collect()}
    means = {r.user_id: r.avg_rating for r in rt.avg_rating(many).collect()}
    found = {(r.user_id, c.item_id): c.value for r in matrix.collect() for c in r.cells}
    assert len(found) == 120 * items and all(v == ratings.get((u, i), means[u]) for (u, i), v in found.items())


def test_dense_matrix_of_ids_far_apart(spark):
    far = spark.createDataFrame([(1, 1, 5.0, 0), (1, 10 ** 11, 3.0, 0), (2, 1, 1.0, 0)], "user_id long, item_id long, rating double, ts long")
    cells = {(r.user_id, c.item_id): c.value for r in rt.dense_matrix(far).collect() for c in r.cells}
    assert cells == {(1, 1): 5.0, (1, 10 ** 11): 3.0, (2, 1): 1.0, (2, 10 ** 11): 1.0}


def test_release_removes_what_was_stored(spark, ratings):
    import os
    from kindred import session
    kept = dict(folders=list(session._made["folders"]), tables=list(session._made["tables"]))
    session._made["folders"].clear(), session._made["tables"].clear()
    session.store(ratings, "gone")
    table = session.store_bucketed(ratings, "gone", "user_id")
    folders, names = list(session._made["folders"]), list(session._made["tables"])
    assert table.count() == 10 and all(os.path.isdir(f) for f in folders)
    session.release(spark)
    assert not any(os.path.exists(f) for f in folders) and not any(spark.catalog.tableExists(n) for n in names)
    session._made.update(kept)


def test_malformed_pairs_and_cells_are_kept_apart(spark, tmp_path):
    path = tmp_path / "pairs"
    path.write_text("1;2\t0.5;rc\n1;3\t0.25\nx;2\t1;rc\n7\t1;rc\n1;2\n5;6\tabc;rt\n\n")
    assert sorted(map(tuple, text.read_pairs(spark, str(path)).collect()), key=str) == [(1, 2, 0.5, "rc"), (1, 3, 0.25, None)]
    assert text.malformed_pairs(spark, str(path)).count() == 4
    path = tmp_path / "matrix"
    path.write_text("1\t10;2.5|11;x|12;4.0&7\nuser\t10;1.0\n2\n3\t10|;|13;1.5\n")
    assert sorted(map(tuple, text.read_packed_matrix(spark, str(path)).collect()), key=str) == [(1, 7, 10, 2.5), (1, 7, 12, 4.0), (3, None, 13, 1.5)]
    assert text.malformed_cells(spark, str(path)).count() == 5
