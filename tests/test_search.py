"""The stored inverted index against looking at every item."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kindred.operators import search


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(stock, queries, k):
    out = []
    for q in set(queries):
        asked, found = set(words(q)), []
        for item, *fields in stock:
            scores = [(-round(sum(w in asked for w in ws) / len(ws), 6), f) for f, ws in zip(("name", "summary"), map(words, fields)) if asked and asked <= set(ws)]
            if scores:
                score, field = min(scores)
                found.append((score, item, field))
        out += [(q, item, field, -score, n + 1) for n, (score, item, field) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("slots", "part_rows"), [(16, 100_000), (3, 7)])
def test_equal_to_looking_at_every_item(spark, tmp_path, slots, part_rows):
    rng = random.Random(slots)
    pool = "red blue small large ring bolt nut gear plate spring the of".split()
    text = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    stock = [(i, None if i % 17 == 0 else text(4), None if i % 13 == 0 else "the " + text(12)) for i in range(200)]
    stock += [(900, "Größe XL-5", "the Größe"), (901, "", "")]
    queries = ["red", "the", "RED ring", "ring red", "the red large", "größe", "xl 5", "5", "unknown", "red unknown", "", "  ", "small small bolt", "gear-plate", "of the"]
    path = str(tmp_path / "index")
    search.build_index(spark.createDataFrame(stock, "item_id long, name string, summary string"), path, slots=slots, part_rows=part_rows)
    asked = spark.createDataFrame([(q,) for q in queries + queries[:3]], "content string")
    for k in (3, 1000):
        got = [(r.content, r.item_id, r.field, r.score, r["rank"]) for r in search.search_index(spark, path, asked, k).collect()]
        assert sorted(got) == brute(stock, queries, k)
    parts = spark.read.parquet(f"{path}/terms").agg(F.max("parts")).first()[0]
    assert parts == (1 if part_rows > 1000 else -(-max(sum("the" in words(s) for _, _, s in stock), 0) // 7))


def test_only_the_slots_of_asked_words_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    search.build_index(spark.createDataFrame([(i, f"word{i} common", None) for i in range(100)], "item_id long, name string, summary string"), path, slots=40)
    asked = spark.createDataFrame([("word7",)], "content string")
    found = search.search_index(spark, path, asked)
    assert [tuple(r) for r in found.collect()] == [("word7", 7, "name", 0.5, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    slot = asked.select(F.pmod(F.xxhash64("content"), F.lit(40)).alias("s")).first()["s"]
    assert any("PartitionFilters" in line and f"= {slot})" in line for line in plan.splitlines())
