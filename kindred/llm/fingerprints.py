"""MinHash document fingerprints: universal hash permutations over word shingles, bands, verified Jaccard.

A signature holds, for each permutation x -> (a x + b) mod 2^64, 16 scrambled bits of the smallest image
of a text's shingles. The share of equal places estimates the Jaccard similarity of two sets, whatever their
size; different minima share a place with probability 2^-16.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import arrow, shingles
from kindred.llm.components import components
from kindred.llm.ngram_join import linked_groups
from kindred.session import store

PERMUTATIONS = 128
BANDS, BAND_ROWS = 25, 5
_random = np.random.default_rng(20)
_A = _random.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64, endpoint=False)
_EMPTY = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest image of any shingle under each permutation; all ones for no shingles."""
    low = _EMPTY
    for start in range(0, len(hashes), 128):
        low = np.minimum(low, (hashes[start:start + 128, None] * _A + _B).min(0))
    return low


def signature(low: np.ndarray) -> np.ndarray:
    """16 bits of each scrambled minimum: its own upper bits are nearly all 0 in a long text. All ones stay so."""
    return np.where(low == _EMPTY, np.uint64(2**64 - 1), shingles.mix(low)).astype(np.uint16)


def signatures(hashes: list[np.ndarray]) -> list[np.ndarray]:
    return [signature(minima(h)) for h in hashes]


def _edits(size: int):
    """Fingerprints of rows in order of bucket and id; a bucket ends with the first row of the next one."""
    def run(batches):
        held = None
        for batch in batches:
            for part in arrow.pieces(batch, "text"):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                rows = list(zip(part.column("bucket").to_pylist(), part.column("tail").to_pylist(),
                                part.column("doc_id").to_pylist(), texts,
                                shingles.shingles(pa.array(texts, pa.large_string()), size), strict=True))
                rows = [(b, t, i, x, h, minima(h)) for b, t, i, x, h in rows]
                if held is not None:
                    rows.insert(0, held)
                yield edited(list(zip(rows[:-1], rows[1:], strict=True)))
                held = rows[-1]

    def edited(pairs):
        pairs = [(a, b) for a, b in pairs if a[0] == b[0] and not a[1]]
        new = [a[3][:len(a[3]) - len(a[3]) // 4] + b[3][:len(a[3]) // 4] for a, b in pairs]
        hashed = shingles.shingles(pa.array(new, pa.large_string()), size)
        out = []
        for (a, b), h, text in zip(pairs, hashed, new, strict=True):
            own = signature(a[5])
            n = min(len(h), len(a[4]))
            differ = np.flatnonzero(h[:n] != a[4][:n])
            other = own if n == len(h) == len(a[4]) and not len(differ) else signature(minima(h))
            out.append((a[2], len(a[3]), text, own.tobytes().hex(), other.tobytes().hex(), float((own == other).mean()),
                        float((own == signature(b[5])).mean())))
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EDITED.types, strict=True)], schema=_EDITED)
    return run


_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _longs(values: list[int]) -> str:
    """SQL of an array of longs; Spark folds it to one literal."""
    return "array(" + ", ".join(f"bigint('{v}')" for v in values) + ")"


def _count_up_to(bounds: list[int], place: str):
    """How many of the sorted bounds are at most the value of a column: first among every so many, then within one stretch."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = f"size(filter({_longs(bounds[::step])}, b -> b <= {place}))"
    within = f"size(filter(slice({_longs(bounds)}, {step} * ({coarse} - 1) + 1, {step}), b -> b <= {place}))"
    return F.expr(f"if({place} < bigint('{bounds[0]}'), 0, {step} * ({coarse} - 1) + {within})").cast("int")


def edited_fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of `docs`.

    The edited text is the text with its last floor(n_chars/4) characters replaced by the first as
    many (or all) of the next document's, by ascending doc_id, after the last the first. near_* is the
    share of equal signature places. Null text counts as empty; texts without words share the
    fingerprint of all ones. Rows that share a doc_id follow each other by their text's hash; a null
    doc_id comes first. A table of one row is followed by itself; an empty one gives no rows.
    Other columns are ignored.

    Rows are dealt into ranges of ids; the first row of a range is also dealt to the range before,
    so texts move once. Only the ranges' bounds and first ids (one per shuffle partition) reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(-2**63)))
    bounds = sorted({int(b) for b in docs.select("doc_id").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts))})
    docs = docs.withColumn("bucket", _count_up_to(bounds, "place"))
    firsts = sorted((r["bucket"], r["first"]) for r in docs.groupBy("bucket").agg(F.min("place").alias("first")).collect())
    # By bucket: its first id, and the bucket before it that holds rows (of the first one, the last).
    first, previous = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for k, (bucket, lowest) in enumerate(firsts):
        first[bucket], previous[bucket] = lowest, firsts[k - 1][0]
    before = F.when(F.col("place") == F.get(F.expr(_longs(first)), F.col("bucket")), F.get(F.expr(_longs(previous)), F.col("bucket")).cast("int"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    dealt = (docs.withColumn("at", F.explode(F.when(before.isNull(), F.array(own))
                                             .otherwise(F.array(own, F.struct(before.alias("bucket"), F.lit(1).alias("tail"))))))
             .select("at.bucket", "at.tail", "doc_id", "text")
             .repartitionByRange(parts, "bucket")
             .sortWithinPartitions("bucket", "tail", "doc_id", F.xxhash64("text")))
    schema = ("doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return (dealt.mapInArrow(_edits(size), schema)
            .select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
                    "edited_fingerprint", "near_edited", "near_next"))


def _bands(size: int):
    def run(batches):
        for batch in batches:
            for part in arrow.pieces(batch, "text"):
                hashed = shingles.shingles(part.column("text"), size)
                keys, digests = [], []
                for h in hashed:
                    rows = signature(minima(h))[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for r in range(BAND_ROWS):
                        key = shingles.mix(key + rows[:, r] * np.uint64(2 * r + 3))
                    keys.append(key.view(np.int64) if len(h) else np.empty(0, np.int64))
                    digests.append(shingles.digest(np.unique(h)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                     pa.array([len(np.unique(h)) for h in hashed], pa.int64()), arrow.lists(keys, pa.int64())],
                    names=["doc_id", "node", "node2", "n", "bands"])
    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, component_id, n_links: documents that share a signature band and have Jaccard >= percent / 100.

    Rows that share a band are compared exactly on their whole sets; a bucket of any size is compared in
    blocks, without a cap. A pair at the threshold shares a band with probability 1 - (1 - 0.8^5)^25 > 0.9999.
    component_id is the smallest doc_id reachable by such links. Texts without words link with
    nothing; rows without doc_id are left out; repeated rows link. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null")
    rows = docs.mapInArrow(_bands(size), "doc_id long, node long, node2 long, n long, bands array<long>")
    rows = store(rows, "signatures")
    classes = store(rows.where("n > 0").groupBy("node", "node2")
                    .agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"), F.first("bands").alias("bands")),
                    "classes")
    buckets = classes.select("node", F.explode("bands").alias("band"))
    leads = buckets.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1")
    stars = buckets.join(leads, "band").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return linked_groups(docs, rows, classes.drop("bands"), components(stars), size, percent).drop("n_shingles")
