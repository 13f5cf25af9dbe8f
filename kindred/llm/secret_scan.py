"""Secret scans over a ledger of blobs: DataFrame operations only.

Every text version is addressed by the SHA-256 of its content. The ledger holds the pairs of blob
and rule version scanned so far; a scan reads only the text of blobs with unseen pairs, once per blob
however many documents hold it, and appends to the ledger and the findings (`scan_into`). Findings are joined
back to all documents (paths) by blob. Null and empty texts are one blob, very long ones are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kindred.session import store, work_path


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and non-overlapping, that have `least` characters in `group` (0: all)."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


# Fixed values. A run of access or hex characters is matched from its first possible place to its end,
# so asking for the length in the pattern keeps the same matches as dropping short ones.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    Rule("forge", 1, r"gh[opsru]_[A-Za-z0-9]{36,}", base=False),
)
# For masking: a key from its BEGIN line to the END line of the same kind, or to the end of the text if there is none.
WHOLE_KEY = Rule("pem", 2, r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----(?s:.*?-----END \1PRIVATE KEY-----|.*)", base=False)
MASKED = tuple(WHOLE_KEY if r.name == "pem" else r for r in RULES)
LEDGER = "blob binary, rule string, version int"
FINDINGS = "blob binary, rule string, version int, start long, end long"


def blob_of(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _matches(rule: Rule) -> Column:
    """Per match, in order: characters since the last match, its length, length of its checked group."""
    text, pattern = F.col("text"), rule.pattern
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    checked = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.length) if rule.group else whole
    found = F.transform(whole, lambda n, i: F.struct(
        F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), i.alias("at"), F.get(between, i).cast("bigint").alias("gap"),
        n.cast("bigint").alias("len"), (F.get(checked, i) >= rule.least).alias("ok")))
    return F.when(F.array_contains("todo", rule.name) & text.rlike(pattern), found).otherwise(F.array().cast(
        "array<struct<rule:string,version:int,at:int,gap:bigint,len:bigint,ok:boolean>>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what the ledger has not seen of `docs` (doc_id, text): paths (doc_id, blob), new findings, new ledger entries.

    start and end of a finding are characters (code points), end exclusive. Null texts are the empty blob.
    A row without doc_id is a path like others; repeated rows share a blob, which is scanned once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paths = store(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), "paths")
    ledger = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    offered = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules]))
    # One document per blob stands for it; ids are made comparable so that a null id can stand too.
    blobs = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-2**63))).alias("stands"))
    unseen = (blobs.select("blob", "stands", offered.alias("r")).select("blob", "stands", "r.*")
              .join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti"))
    todo = store(unseen.groupBy("blob", "stands").agg(F.collect_set("rule").alias("todo")), "unseen")
    texts = (docs.withColumns({"stands": F.coalesce("doc_id", F.lit(-2**63)), "blob": blob_of(F.col("text"))})
             .join(todo, ["stands", "blob"]))
    found = (texts.select("blob", F.explode(F.concat(*[_matches(r) for r in rules])).alias("m")).select("blob", "m.*")
             .dropDuplicates(["blob", "rule", "version", "at"]))
    order = Window.partitionBy("blob", "rule", "version").orderBy("at")
    findings = (found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).where("ok")
                .select("blob", "rule", "version", (F.col("end") - F.col("len")).alias("start"), "end"))
    entries = todo.select("blob", F.explode("todo").alias("rule"))
    versions = F.lit(None).cast("int")
    for r in rules:
        versions = F.when(F.col("rule") == r.name, r.version).otherwise(versions)
    return paths, store(findings, "findings"), entries.withColumn("version", versions)


def report(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<rule> of the base rules, base_sha256, spans: one row per path.

    spans joins rule:start:end by start, then rule as listed; base_sha256 hashes those of the base rules.
    Documents without findings have counts 0 and empty spans.
    """
    number = F.lit(0)
    for k, r in enumerate(rules):
        number = F.when(F.col("rule") == r.name, k).otherwise(number)
    spans = findings.withColumn("number", number).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", "number", "end", "rule"))).alias("found"))
    base = [r.name for r in rules if r.base]

    def joined(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    kept = F.filter("found", lambda s: s["rule"].isin(base))
    spans = spans.select("blob", *[F.expr(f"size(filter(found, s -> s.rule = '{n}'))").cast("bigint").alias(f"n_{n}") for n in base],
                         joined(kept).alias("base"), joined(F.col("found")).alias("spans"))
    return (paths.join(spans, "blob", "left")
            .select("doc_id", *[F.coalesce(f"n_{n}", F.lit(0)).cast("bigint").alias(f"n_{n}") for n in base],
                    F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                    F.coalesce("spans", F.lit("")).alias("spans")))


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What runs before this one left in a folder of the ledger; nothing if there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(folder)
    return spark.createDataFrame([], schema)


def scan_into(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, int]:
    """Scan what the ledger below `path` has not seen, and add to it: paths (doc_id, blob), all its findings by these rules, blobs scanned.

    path/findings and path/ledger (a row per blob and rule version) grow by a folder a run; findings come first, so
    a run that fails in between is only scanned again, and findings are read without repeats.
    """
    spark = docs.sparkSession
    ledger = _stored(spark, f"{path}/ledger", LEDGER)
    paths, findings, entries = scan(docs, rules, ledger)
    findings.write.mode("append").parquet(f"{path}/findings")
    entries = store(entries, "entries")
    entries.write.mode("append").parquet(f"{path}/ledger")
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    found = _stored(spark, f"{path}/findings", FINDINGS).where(F.array_contains(wanted, F.struct("rule", "version"))).distinct()
    return paths, found, entries.select("blob").distinct().count()


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """One row per row of `docs` as in `report`, through the ledger below `path` (a new one if not given). An empty table gives no rows."""
    paths, findings, _ = scan_into(docs, path or work_path(docs.sparkSession, "secrets"), rules)
    return report(paths, findings, rules)
