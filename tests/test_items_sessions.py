import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import scalar as fx
from kindred.operators import items, sessions

HOUR = 3_600_000_000


def vectors(spark, rows):
    return spark.createDataFrame(rows, "item_id long, embedding array<double>")


def test_nearest_items_keep_copies_and_drop_self(spark):
    stock = vectors(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])])
    found = {(r.item_id, r.item_rec): r.score for r in items.item_knn(stock, 3).collect()}
    assert found == {(1, 2): 1.0, (1, 3): 0.71, (2, 1): 1.0, (2, 3): 0.71, (3, 1): 0.71, (3, 2): 0.71}
    assert not any(s == 1.0 for s in (r.score for r in items.item_knn(stock, 3, drop_exact=True).collect()))


def test_blocks_give_the_exact_nearest(spark, monkeypatch):
    monkeypatch.setattr(items, "BLOCK_BYTES", 0)
    monkeypatch.setattr(items, "SCORES_AT_ONCE", 3000)
    rng = random.Random(5)
    copy = [rng.gauss(0, 1) for _ in range(4)]
    rows = [(i, copy if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(1500)]
    stock = vectors(spark, rows)
    queries = stock.where("item_id < 6").select(F.col("item_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows}
    found = items.search_items_vector(queries, stock, 10).collect()
    for q in range(6):
        best = sorted((-round(sum(a * b for a, b in zip(unit[q], v)), 10), i) for i, v in unit.items())[:10]
        got = sorted((r["rank"], r.item_id) for r in found if r.query_id == str(q))
        assert [i for _, i in got] == [i for _, i in best]


def test_search_by_words(spark):
    stock = spark.createDataFrame([(1, "large ring"), (2, "Large red ring"), (3, "ring"), (4, "large ring"), (5, "rings large")],
                                  "item_id long, name string")
    asked = spark.createDataFrame([("ring large",), ("ring large",), ("blue",), ("Ring",)], "content string")
    found = {(r.content, r["rank"]): r.item_id for r in items.search_items_text(asked, stock, 2).collect()}
    assert found == {("ring large", 1): 1, ("ring large", 2): 4, ("Ring", 1): 3, ("Ring", 2): 1}


def test_keys_and_new_items(spark):
    keys = spark.createDataFrame([("ecommerce:product:12",), ("ecommerce:sim:3",)], "key string")
    assert [r.item_id for r in items.extract_item_id(keys).collect()] == [12]
    stored = vectors(spark, [(1, [1.0, 0.0])])
    names = spark.createDataFrame([(1, "old one"), (2, "new thing"), (2, "new thing")], "item_id long, name string")
    embed = lambda new: new.select("item_id", F.array(F.length("name").cast("double"), F.lit(0.0)).alias("embedding"))
    found = {r.item_id: (r.embedding, r.is_new) for r in items.upsert_items(stored, names, embed).collect()}
    assert found == {1: ([1.0, 0.0], False), 2: ([9.0, 0.0], True)}


def test_embedding_reads_the_whole_text(spark):
    long = "alpha " * 5000
    docs = spark.createDataFrame([(1, long + "omega"), (2, long), (3, "beta")], "item_id long, name string")
    found = {r.item_id: r.embedding for r in items.embed_text(docs, 256).collect()}
    assert found[1] != found[2]
    assert all(sum(x * x for x in v) == pytest.approx(1.0) for v in found.values())


def test_sessions_split_at_the_gap(spark):
    tenths = [0, 50, 109, 169, 400, 460]
    times = [t * HOUR // 10 for t in tenths[:-1]] + [46 * HOUR - 1]
    events = spark.createDataFrame([(1, t) for t in times] + [(2, 0)], "user_id long, ts long")
    found = sessions.sessionize(events, 6 * 3600).collect()
    starts = [r.created_at for r in sorted(found, key=lambda r: r.ts) if r.user_id == 1]
    assert starts == [0, 0, 0, times[3], times[4], times[4]]


def test_newest_sessions_count_rows_and_keep_ties(spark):
    tie_inside = [("a", 1, 60), ("b", 1, 50), ("c", 1, 50), ("d", 1, 40), ("e", 1, 30), ("f", 1, 20)]
    tie_at_border = [("g", 2, 60), ("h", 2, 50), ("i", 2, 40), ("j", 2, 30), ("k", 2, 30), ("l", 2, 20)]
    df = spark.createDataFrame(tie_inside + tie_at_border, "session_id string, user_id long, created_at long")
    kept = {r.session_id for r in sessions.newest_sessions(df, 4).collect()}
    assert kept == set("abcd") | set("ghijk")


def test_session_items_and_searches(spark):
    found = spark.createDataFrame([("s1", 1, 10), ("s2", 1, 20)], "session_id string, user_id long, created_at long")
    activity = spark.createDataFrame([("s1", 0, 5), ("s2", 1, 6), ("s2", 2, 7), ("s2", 9, 8)], "session_id string, action int, item_id long")
    recent = {(r.item_id, r.weight) for r in sessions.recent_session_items(found, activity).collect()}
    assert recent == {(5, 0.2), (6, 0.5), (7, 0.3)}
    searches = spark.createDataFrame([("s1", "old", 11), ("s2", "x", 21), ("s2", "y", 22)], "session_id string, content string, searched_at long")
    assert [(r["rank"], r.content) for r in sessions.latest_searches(found, searches).orderBy("rank").collect()] == [(1, "y"), (2, "x")]


def test_candidates_ranked_once_and_rated_ones_dropped(spark):
    stock = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0])])
    seen = spark.createDataFrame([(7, 1, 0.5), (7, 1, 0.2), (7, 2, 0.3)], "user_id long, item_id long, weight double")
    wanted = spark.createDataFrame([(7, 3), (7, 3), (7, 4), (7, 2)], "user_id long, item_id long")
    ranked = sessions.rank_candidates(seen, wanted, stock).orderBy("rank").collect()
    assert [r.item_id for r in ranked] == [3, 2, 4]
    assert [r.score for r in ranked] == pytest.approx([0.5 * math.sqrt(0.5), 0.3, 0.0])
    upward = sessions.rank_candidates(seen, wanted, stock, order="asc").orderBy("rank").collect()
    assert [r.item_id for r in upward] == [4, 2, 3]
    rated = spark.createDataFrame([(7, 2)], "user_id long, item_id long")
    assert {r.item_id for r in sessions.exclude_rated(wanted, rated).collect()} == {3, 4}
    assert {r.item_id for r in sessions.split_rated(wanted, rated).where("rated").collect()} == {2}


def test_payload(spark):
    top = spark.createDataFrame([(7, 3, 4.5, 1), (7, 4, 4.0, 2)], "user_id long, item_id long, prediction double, rank int")
    payload = json.loads(sessions.recommendation_payload(top).first().payload)
    assert payload == {"customer_id": "7", "list": [{"product_id": "3", "predict_rating": "4.5"},
                                                    {"product_id": "4", "predict_rating": "4.0"}]}


def test_expressions(spark):
    row = spark.range(1).select(
        fx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        fx.euclidean(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("five"),
        fx.euclidean(F.array(F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("uneven"),
        fx.round_to(F.lit(-1.2345), 2).alias("r"), fx.clamp(F.lit(7.0), 1, 5).alias("c")).first()
    assert row.zero is None and row.five == 5.0 and row.uneven is None and row.r == -1.23 and row.c == 5.0


def test_one_new_item_and_an_empty_name_are_not_lost(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([(1, [1.0] * 64)], "item_id long, embedding array<double>").write.parquet(path)
    catalogue = spark.createDataFrame([(1, "old one"), (2, "new thing"), (3, "")], "item_id long, name string")
    alone = {r.item_id: r.embedding for r in items.new_items(spark.read.parquet(path), catalogue.where("item_id = 2")).collect()}
    assert alone == {2: [0.0] * 64}
    items.append_items(spark, path, catalogue)
    items.append_items(spark, path, catalogue)
    found = {r.item_id: r.embedding for r in spark.read.parquet(path).collect()}
    assert sorted(found) == [1, 2, 3] and spark.read.parquet(path).count() == 3
    assert found[3] == [0.0] * 64 and sum(x * x for x in found[2]) == pytest.approx(1.0)


def test_best_of_a_block_is_that_of_sorting_it_and_sorts_little(monkeypatch):
    rng = np.random.default_rng(5)
    stock = rng.normal(size=(7000, 8))
    stock[::9] = stock[4]  # copies tie, and more of them than are asked for
    stock /= np.linalg.norm(stock, axis=1)[:, None]
    for scores in (stock[:40] @ stock.T, np.round(stock[:40] @ stock.T, 1), stock[:40] @ stock.T + rng.normal(size=(40, 7000)) * 1e-11):
        rounded = np.round(scores, 10)
        best = np.argsort(-rounded, axis=1, kind="stable")[:, :21]
        row, column, score = items._best(scores, 21)
        assert (row.reshape(best.shape) == np.arange(40)[:, None]).all() and (column.reshape(best.shape) == best).all()
        assert (score.reshape(best.shape) == np.take_along_axis(rounded, best, axis=1)).all()
    sizes, plain = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or plain(keys))
    monkeypatch.setattr(np, "argsort", None)
    items._best(rng.normal(size=(40, 7000)), 21)
    assert sizes and sizes[0] < 40 * 7000 / 50
