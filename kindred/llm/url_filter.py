"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

DataFrame and MLlib operations only; trees are learned from labelled URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import broadcast_if_small, store

# Verdict and host/path of each rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FEATURES = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "params", "hyphens", "secure",
            "fragment", "suffix_share"]
SUFFIXES_SENT = 20_000


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def parts(urls: DataFrame) -> DataFrame:
    """`urls` with host (A-Z lower-cased) and path; both empty where the url is null or has no ://."""
    rest = F.coalesce(_after_scheme(F.col("url")), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule whose host or subdomain and path prefix fit, else null."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path; a null url counts as empty."""
    url = F.coalesce("url", F.lit(""))

    def count(text: Column, letters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, letters, ""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda sum_, c: sum_ + F.when(c == "", 0.0).otherwise(
        (lambda p: -p * F.log2(p))((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)))
    labels = F.split("host", r"\.")
    urls = urls.withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "labels": F.size(labels).cast("double"), "depth": count(F.col("path"), "/").cast("double"), "digit_ratio": count(url, "0123456789") / n,
        "entropy": entropy, "params": count(url, "=&").cast("double"), "hyphens": count(url, "-_").cast("double"),
        "secure": url.startswith("https://").cast("double"), "fragment": url.contains("#").cast("double"), "suffix": F.element_at(labels, -1)})
    suffixes = store(urls.groupBy("suffix").agg(F.count("*").alias("with_suffix")), "suffixes")
    total = suffixes.agg(F.sum("with_suffix")).first()[0] or 1
    suffixes = suffixes.select("suffix", (F.col("with_suffix") / F.lit(total)).alias("suffix_share"))
    return urls.join(broadcast_if_small(suffixes, SUFFIXES_SENT), "suffix")


def fit(labelled: DataFrame, most: int = 20_000, trees: int = 10, depth: int = 4):
    """Trees from lexical rows with `label` (1.0 block, 0.0 allow), on about `most` distinct urls chosen by hash.

    Each label has half of them, or more where the others have fewer urls; while there are no more than `most`, all are
    used. A url weighs as many rows as it has, divided by its label's share, so labels weigh as in all rows.
    None if there are not two classes.
    """
    labelled = labelled.where("label is not null")
    urls = labelled.groupBy("label", "url").agg(F.count("*").alias("copies"))
    counts = {r["label"]: r["count"] for r in urls.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share, left = F.lit(0.0), most
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda c: c[1])):
        own = min(n, left // (len(counts) - k))
        share, left = F.when(F.col("label") == label, own / n).otherwise(share), left - own
    chosen = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 53)) < share * (1 << 53))
    sample = (chosen.groupBy("label", "url").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in FEATURES])
              .withColumn("weight", F.col("copies") / share).na.fill(0.0, FEATURES))
    rows = store(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label", "weight"), "labelled-urls")
    if rows.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=11, weightCol="weight").fit(rows)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of `pages` (page_id, url).

    The trees learn from the urls that a rule judges and judge the others: block from a score of 0.5 on. If
    the rules label no url or give only one verdict, the others are allowed with score 0. A null url, or one
    without ://, has empty host and path. Repeated rows and null ids are rows like others; other columns are ignored.
    """
    urls = lexical(ruled(parts(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"))), rules))
    model = fit(urls.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double")))
    if model is None:
        scored = urls.withColumn("score", F.lit(0.0))
    else:
        scored = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(urls.na.fill(0.0, FEATURES))
        scored = model.transform(scored).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
