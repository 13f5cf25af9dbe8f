"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a maximal stretch of words with smallest period q (words q apart are identical) that is at least
`least` words and REPEATS periods long. At scale B = 1, 2, 4, ... the words are cut into blocks of B, and
periods from B to 2B - 1 are sought:

1. A block's sums of squared differences (of word numbers) to all following windows at distances B to 2B - 1
   are one correlation, computed by number-theoretic transforms. As many primes are used as their product needs
   to exceed the largest possible sum, so a sum is zero modulo all of them only if no word mismatches. Blocks
   holding a word that does not come again within 2B words have no such window and are left out.
2. A run of period q contains two neighbouring blocks that both have a zero at distance q. Such distances seed
   a stretch, extended to both sides word by word; as the blocks beyond have no zero, by less than B words.
3. A seed within a stretch of a shorter period belongs to a multiple of that period and is dropped. Two neighbouring
   blocks at a distance below 2B span more than two periods, so the shorter period divides the distance (Fine
   and Wilf), its stretch is known from an earlier scale, and at most one such stretch covers them. A block
   whose windows all lie within a known stretch needs no transform.

All documents of a bounded piece of text are worked on at once, a mark of its own after each: the work is
n log^2 n in a text's words at most, whatever it repeats. Each row is handled in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import arrow

REPEATS = 4
LEAST = 6
# Primes below 2^31 with 2^26, 2^27 and 2^23 dividing p - 1, and a primitive root of each.
PRIMES = ((469762049, 3), (2013265921, 31), (998244353, 3))
CHUNK = 1 << 18
PIECE = 1_000_000
_U = np.uint64
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=256)
def _roots(prime: int, generator: int, half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 * half, as a column."""
    base = pow(generator, (prime - 1) // (2 * half), prime)
    base = pow(base, -1, prime) if inverse else base
    powers = np.ones(1, _U)
    while len(powers) < half:
        powers = np.concatenate([powers, powers * _U(pow(base, len(powers), prime)) % _U(prime)])
    return powers[:, None]


def _forward(a: np.ndarray, prime: int, generator: int) -> None:
    """Transform the columns of `a` in place; the result is in bit-reversed order."""
    half, p = len(a) // 2, _U(prime)
    while half:
        v = a.reshape(-1, 2, half, a.shape[1])
        total, rest = v[:, 0] + v[:, 1], v[:, 0] + p - v[:, 1]
        v[:, 0] = total % p
        v[:, 1] = rest * _roots(prime, generator, half, False) % p
        half //= 2


def _backward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The inverse of `_forward`, in place."""
    half, p = 1, _U(prime)
    while half < len(a):
        v = a.reshape(-1, 2, half, a.shape[1])
        turned = v[:, 1] * _roots(prime, generator, half, True) % p
        v[:, 1] = (v[:, 0] + p - turned) % p
        v[:, 0] = (v[:, 0] + turned) % p
        half *= 2
    a *= _U(pow(len(a), -1, prime))
    a %= p
    return a


def _zeros(x: np.ndarray, blocks: np.ndarray, size: int, primes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers and distances (size to 2 size - 1) of all windows without mismatch, for given blocks of `x`."""
    block = x[(blocks * size)[:, None] + np.arange(size)]
    window = x[(blocks * size + size)[:, None] + np.arange(2 * size)]
    zero = np.ones((size, len(blocks)), bool)
    for prime, generator in primes:
        p = _U(prime)
        a = np.zeros((2 * size, len(blocks)), _U)
        a[:size] = block[:, ::-1].T % p
        b = np.ascontiguousarray(window.T) % p
        squares = np.zeros((2 * size + 1, len(blocks)), _U)
        np.cumsum(b * b % p, axis=0, out=squares[1:])
        total = (a * a % p).sum(0) + squares[size:2 * size] - squares[:size]
        _forward(a, prime, generator)
        _forward(b, prime, generator)
        products = _backward(a * b % p, prime, generator)[size - 1:2 * size - 1]
        zero &= total % p == 2 * products % p
    t, k = np.nonzero(zero)
    return blocks[k], t + size


def _reach(x: np.ndarray, at: np.ndarray, period: np.ndarray, size: int, step: int) -> np.ndarray:
    """How many words from `at` on in direction `step` equal the word `period` further on; below `size`."""
    out = np.empty(len(at), np.int64)
    many = max(1, CHUNK // size)
    for k in range(0, len(at), many):
        places = at[k:k + many, None] + step * np.arange(size)
        # Left of the first word nothing matches; on the right there are marks enough.
        same = (places >= 0) & (x[np.maximum(places, 0)] == x[np.maximum(places, 0) + period[k:k + many, None]])
        same[:, -1] = False
        out[k:k + many] = same.argmin(1)
    return out


def _until(begins: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the stretches that begin at or before each place end at the latest (0: there is none)."""
    return np.append(ends, 0)[np.searchsorted(begins, at, side="right") - 1]


def stretches(x: np.ndarray, longest: int, numbers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of the runs of REPEATS periods or more in `x`, and of some shorter ones.

    `x` holds word numbers (uint64, below `numbers`), a mark of its own after each text, and `longest` + 8 such marks at
    its end; `longest` is the number of words of the longest text.
    """
    following = np.full(len(x), len(x), np.int64)
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    following[order[again]] = order[again + 1] - order[again]
    del order, again
    found = [np.empty((3, 0), np.int64)]
    begins, covered = np.empty(0, np.int64), np.empty(0, np.int64)
    size = 1
    while REPEATS * size <= longest:
        count = (len(x) - longest - 8) // size
        alive = following[:count * size].reshape(count, size).max(1) < 2 * size
        beside = np.zeros(count + 2, bool)
        beside[1:-1] = alive
        blocks = np.flatnonzero(alive & (beside[:-2] | beside[2:]))
        blocks = blocks[_until(begins, covered, blocks * size) < blocks * size + 4 * size - 1]
        needed, product = [], 1
        for prime in PRIMES:
            needed.append(prime)
            product *= prime[0]
            if product > size * numbers * numbers:
                break
        seeds = []
        many = max(1, CHUNK // (2 * size))
        for k in range(0, len(blocks), many):
            b, d = _zeros(x, blocks[k:k + many], size, tuple(needed))
            new = _until(begins, covered, b * size) < b * size + 2 * size + d
            seeds.append(np.stack([d[new], b[new]]))
        d, b = np.concatenate(seeds, 1) if seeds else np.empty((2, 0), np.int64)
        order = np.lexsort((b, d))
        d, b = d[order], b[order]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1] + 1)
        first = np.flatnonzero(first)
        blocks_in = np.diff(np.append(first, len(d)))
        first, blocks_in = first[blocks_in > 1], blocks_in[blocks_in > 1]
        if len(first):
            d, start = d[first], b[first] * size
            end = start + blocks_in * size
            start = start - _reach(x, start - 1, d, size + 1, -1)
            end = end + _reach(x, end, d, size + 1, 1)
            found.append(np.stack([start, end + d - start, d]))
            known = np.concatenate(found, 1)
            known = known[:, np.argsort(known[0], kind="stable")]
            begins, covered = known[0], np.maximum.accumulate(known[0] + known[1])
        size *= 2
    return tuple(np.unique(np.concatenate(found, 1), axis=1))


def _runs(least: int):
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = arrow.packed_words(part.column("text"), _INSIDE)
        n, docs = np.diff(bounds), part.num_rows
        longest = int(n.max(initial=0))
        shifted = bounds[:-1] + np.arange(docs)
        x = np.empty(len(words) + docs + longest + 8, _U)
        numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.empty(0, np.int64)
        at = np.arange(len(words)) + np.repeat(np.arange(docs), n)
        top = int(numbers.max(initial=-1)) + 1
        marks = np.ones(len(x), bool)
        marks[at] = False
        x[at] = numbers
        x[marks] = np.arange(top, top + marks.sum())
        start, length, period = stretches(x, longest, top + int(marks.sum()))
        whole = length >= np.maximum(least, REPEATS * period)
        start, length, period = start[whole], length[whole], period[whole]
        doc = np.searchsorted(shifted, start, side="right") - 1
        start = start - doc  # among the words without marks
        order = np.lexsort((period, start))
        start, length, period, doc = start[order], length[order], period[order], doc[order]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        keep = np.cumsum(change[:-1]) == 0
        kept = np.zeros(len(words) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        left = pa.ListArray.from_arrays(pa.array(kept[bounds], pa.int32()), words.filter(pa.array(keep)).cast(pa.binary()))
        fields = {"start": start - bounds[doc], "length": length, "period": period}
        told = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in fields.values()], names=list(fields))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()), told),
             pc.binary_join(left, b" ").cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            for part in arrow.pieces(batch, "text", PIECE):
                yield work(part)
    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: by start, then period) and collapsed of every row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0 and compared as they stand. collapsed is the words
    joined by one space without those that a run contains after its first period. Null, empty and blank texts have no
    words, no runs and an empty collapsed text. Each row is treated by itself, so repeated rows and null ids give a row
    each; a very long text is a piece of its own. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(_runs(least), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _tails(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for k, name in enumerate(batch.column("doc_id").to_pylist()):
            h = None if name is None or texts[k] is None else zlib.crc32(str(name).encode())
            if h is not None and h % 10 == 0 and (words := _WORD.findall(texts[k])):
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[k] = " ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def repeating_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text, where one row in ten (by the CRC-32 of its id) repeats a part of its words from some word on to its end.

    These texts are their words joined by one space; the others, and those of rows without id, stay as they are.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_tails, "doc_id long, text string")


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of rows of `periodic_runs`.

    The four values are null where there is no run; of equally long runs the first counts, then the shorter period.
    """
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", (-F.col("best.shorter")).alias("length"), "best.period",
        F.expr("-1000 * best.shorter div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
