"""Source divergence audit: how far the word use of each source of a language lies from the others'.

Of each language the terms in at least `least` documents are kept. A group (language, source) gives a kept term that it
holds n times the price p = 1 + floor(SCALE * (n + 1) / (N + V)), N being its occurrences of kept terms and V their
number; what a term adds to the distance from p to q is floor((p - q)^2 / q). A price follows from the group and the
count alone, so the sum over all terms needs only how many terms have which two counts: the joint table of two groups.

Joint tables are products of one-hot matrices. Rows are terms; there is one indicator column for each group and count
level above 0 that occurs. The matrix is cut into blocks of about ROWS terms (by hash, so that a language that holds
most documents is many blocks) by SOURCES sources, each pair of source blocks meeting in one cell; a cell
multiplies the transpose with the matrix in pieces of up to COLUMNS columns, terms with alike totals together since
these share their levels. Products of zeros and ones are exact in single precision up to 2^24 rows. Level 0
follows from the margins: a joint count enters the sum with f(a, b) - f(a, 0) - f(0, b) + f(0, 0), and each level of either
group alone with f(a, 0) - f(0, 0). As the sum is linear in the joint table, a cell prices its own part, and
one row per pair of groups leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kindred.llm import arrow
from kindred.session import store

SCALE = 1_000_000_000
ROWS = 1024
SOURCES = 256
COLUMNS = 1024
LANES = 32
PIECE = 2_000_000
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
EXACT = "decimal(38,0)"


def _counts(batches):
    """Per piece of text: lang, source, term, its occurrences and the documents that hold it."""
    for batch in batches:
        for part in arrow.pieces(batch, "text", PIECE):
            terms, bounds = arrow.packed_words(part.column("text"), _TERM, lower=True)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            width, sources = len(coded.dictionary), len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy()
            doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            held, times = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
            keys, place = np.unique(group[held // width] * width + held % width, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, place, times)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(keys // width // sources)), source.dictionary.take(pa.array(keys // width % sources)),
                 coded.dictionary.take(pa.array(keys % width)).cast(pa.binary()).cast(pa.string()), pa.array(n), pa.array(np.bincount(place))],
                names=["lang", "source", "term", "n", "docs"])


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in decimals where longs would not hold the product."""
    above = F.lit(SCALE).cast(EXACT) * (count.cast("decimal(19,0)") + 1)
    return F.call_function("div", above.cast(EXACT), F.greatest(total + kept, F.lit(1)).cast(EXACT)) + 1


def surprise(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs from 1 to SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """lang, source, term, n (occurrences in the group), total (in the language), lead (one row per term) of all kept terms."""
    counts = (docs.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
              .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    return (counts.withColumns({"held": F.sum("docs").over(term), "total": F.sum("n").over(term),
                                "lead": (F.row_number().over(term.orderBy("source")) == 1).cast("int")})
            .where(F.col("held") >= least).select("lang", "source", "term", "n", "total", "lead"))


def _joint(rows: np.ndarray, group: np.ndarray, p: np.ndarray, nil: np.ndarray, side: np.ndarray, groups: int, out: np.ndarray) -> None:
    """Add to `out` (groups x groups) what the joint tables of one piece's entries add; entries are sorted by row."""
    # Levels of one group have different prices, except where neighbouring counts round to the same; those share a column.
    column, first, place = np.unique(group * (2 * SCALE) + p, return_index=True, return_inverse=True)
    row = np.cumsum(np.append(0, rows[1:] != rows[:-1]))
    if len(column) > COLUMNS and row[-1]:
        cut = np.searchsorted(row, (row[-1] + 1) // 2)
        for part in (slice(0, cut), slice(cut, None)):
            _joint(rows[part], group[part], p[part], nil[part], side[part], groups, out)
        return
    hot = np.zeros((row[-1] + 1, len(column)), np.float32)
    hot[row, place] = 1
    g, p, nil, side = group[first], p[first], nil[first], side[first]
    # Each pair once; in cells of two source blocks only pairs across.
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    joint = hot[:, left].T @ hot[:, right]
    a, b = np.nonzero(joint)
    times = joint[a, b].astype(np.int64)
    a, b = left[a], right[b]
    once = (g[a] < g[b]) | (side[a] == 0)
    a, b, times = a[once], b[once], times[once]
    for x, y in ((a, b), (b, a)):
        def f(u, v):
            return (u - v) * (u - v) // v
        value = f(p[x], p[y]) - f(p[x], nil[y]) - f(nil[x], p[y]) + f(nil[x], nil[y])
        np.add.at(out, (g[x], g[y]), times * value)


def _cell(entries: pa.Table) -> pa.RecordBatch:
    rows, p, nil, n, side, group = (entries.column(c).to_numpy() for c in ("row", "p", "nil", "n", "side", "grp"))
    names, group = np.unique(group, return_inverse=True)
    _, start, row = np.unique(rows, return_index=True, return_inverse=True)
    # The largest terms first: those of a piece have alike levels.
    total = np.zeros(len(start), np.int64)
    np.add.at(total, row, n)
    rank = np.empty(len(start), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(start))
    order = np.argsort(rank[row], kind="stable")
    out = np.zeros((len(names), len(names)), np.int64)
    _joint(rank[row][order], group[order], p[order], nil[order], side[order], len(names), out)
    g, h = np.nonzero(out)
    return pa.RecordBatch.from_arrays([pa.array(names[g]), pa.array(names[h]), pa.array(out[g, h])], names=["g", "h", "value"])


def _cells(batches):
    for entries in arrow.runs(batches, "cell"):
        yield _cell(entries)


def joint_prices(kept: DataFrame) -> DataFrame:
    """g, h, value: what the joint tables of levels above 0 add for each ordered pair of groups with a common term.

    `kept` has lang, term, n and of its group grp, p, nil (the price of count 0), kept (V) and sources (of the language).
    """
    blocks = F.ceil(F.col("sources") / SOURCES)
    own = F.pmod(F.xxhash64("grp"), blocks)
    meet = F.expr("transform(sequence(0L, blocks - 1), j -> struct(least(own, j) as lo, greatest(own, j) as hi, if(own = j, 2, int(own > j)) as side))")
    entries = (kept.withColumns({"row": F.xxhash64("lang", "term"), "blocks": blocks, "own": own})
               .withColumn("part", F.expr(f"pmod(xxhash64(row), ceil(kept / {ROWS}))")).withColumn("at", F.explode(meet))
               .select(F.xxhash64("lang", "part", "at.lo", "at.hi").alias("cell"), "row", "grp", "n", "p", "nil", "at.side"))
    return (entries.repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(_cells, "g long, h long, value long"))


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each group to the other sources, and its most telling terms.

    Terms are runs of letters A to Z and of non-ASCII characters of the whole texts, A to Z lower-cased. Part `pair` has a row for
    every other source of the language, its value summed over all kept terms (0 without any); part `term` has the `top`
    terms that the group prices above its language. rank is 1 for the largest value of a group and part, ties by item.

    Null text, lang and source are empty strings. Repeated rows count as documents of their own; doc_id and
    other columns are ignored. A group without terms has its pairs too. An empty table gives no rows. The pairs are as
    many as the square of a language's sources: that is the result asked for.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = store(kept_terms(docs, least), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("lead").alias("kept"), F.sum("n").alias("lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    names = docs.select("lang", "source").distinct()
    counts = names.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = (names.join(counts, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
              .na.fill(0, ["kept", "lang_n", "group_n"]).withColumn("nil", price(F.lit(0), F.col("group_n"), F.col("kept")))
              .withColumn("grp", F.monotonically_increasing_id()))
    groups = store(groups, "groups")
    priced = kept.join(groups, ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("group_n"), F.col("kept")))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    q = price(F.col("total"), F.col("lang_n"), F.col("kept"))
    terms = (priced.withColumn("q", q).where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), surprise(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))

    levels = priced.groupBy("lang", "grp", "nil", "p").agg(F.count("*").alias("times"))
    levels = levels.withColumn("lane", F.pmod(F.xxhash64("grp", "p"), F.lit(LANES)))
    others = (groups.select("lang", F.col("grp").alias("other"), F.col("nil").alias("other_nil"))
              .withColumn("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LANES - 1).cast("bigint")))))
    p, nil, other = F.col("p"), F.col("nil"), F.col("other_nil")
    margins = (levels.join(others, ["lang", "lane"]).where("grp != other").groupBy("grp", "other")
               .agg(F.sum((F.col("times") * (surprise(p, other) - surprise(nil, other))).cast(EXACT)).alias("near"),
                    F.sum((F.col("times") * (surprise(other, p) - surprise(other, nil))).cast(EXACT)).alias("far")))
    margins = margins.select(F.explode(F.array(F.struct(F.col("grp").alias("g"), F.col("other").alias("h"), F.col("near").alias("value")),
                                               F.struct(F.col("other").alias("g"), F.col("grp").alias("h"), F.col("far").alias("value")))).alias("m")).select("m.*")
    x = groups.select("lang", "source", F.col("grp").alias("g"), F.col("nil").alias("g_nil"), "kept")
    y = groups.select("lang", F.col("source").alias("item"), F.col("grp").alias("h"), F.col("nil").alias("h_nil"))
    pairs = x.join(y, "lang").where("g != h")
    joint = joint_prices(priced).select("g", "h", F.col("value").cast(EXACT).alias("value"))
    summed = margins.unionAll(joint).groupBy("g", "h").agg(F.sum("value").alias("extra"))
    value = (F.col("kept") * surprise(F.col("g_nil"), F.col("h_nil"))).cast(EXACT) + F.coalesce("extra", F.lit(0).cast(EXACT))
    pairs = (pairs.join(summed, ["g", "h"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value"))
             .withColumn("rank", F.row_number().over(ranked)))
    return pairs.unionAll(terms)
