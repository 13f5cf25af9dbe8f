"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kindred.llm import periodic
from kindred.llm.session import prepare

DOCS = "doc_id long, text string, runs string, n_words int, period long, best string"


def runs_of(words, least=6):
    """(start, length, period) of all runs, by trying every period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n\x0b ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "a\x85a a\x85a a\x85a a\x85a a\x85a a\x85a",
           "x " + "a b " * 3, "x " + "a b " * 4, "é 日 " * 9 + "é", "a " * 5000 + "b " + "a " * 5000, ("a a a a a a b " * 40).strip(),
           " ".join(f"w{k % 700}" for k in range(2800)), " ".join(f"w{k % 701}" for k in range(2800))]
    for _ in range(250):
        words = [rng.choice("abcde"[:rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.randrange(3)):
            start, at = rng.randrange(len(words)), rng.randrange(len(words))
            words[at:at] = words[start:start + rng.randrange(1, 12)] * rng.randrange(2, 8)
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    rows = [(k, t, "clash", 1, 2, "clash") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[9:11] + [(None, "a b " * 9, "", 0, 0, ""), (None, None, None, None, None, None)], DOCS)


def split(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def test_runs_and_collapsed_texts_equal_brute_force(odd):
    given = sorted(((r["doc_id"] is None, r["doc_id"] or 0, split(r["text"])) for r in odd.collect()))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["collapsed"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
                 for r in periodic.periodic_runs(odd).collect())
    want = []
    for unnamed, name, words in given:
        runs = runs_of(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        text = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((unnamed, name, len(text), len(words), runs, text))
    assert got == sorted(want)


def test_digests_and_repeating_tails(odd):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in periodic.run_digests(periodic.periodic_runs(periodic.repeating_tails(docs))).collect()}
    changed = 0
    for r in docs.collect():
        words, h = split(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        runs = runs_of(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert tuple(got[r["doc_id"]]) == (
            r["doc_id"], len(runs), s, n, q, n and 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
    assert changed > 10


def test_empty_table(spark, odd):
    assert periodic.run_digests(periodic.periodic_runs(periodic.repeating_tails(odd.limit(0)))).collect() == []


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_zeros_are_windows_without_mismatch_for_every_number_of_primes(size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, 3, 64 * size).astype(np.uint64)
    x[8 * size:40 * size] = np.resize(x[:size + size // 2], 32 * size)
    x[x == 2] = np.uint64(2**20 + 7)  # sums of squares above the first prime
    want = {(b, d) for b in range(60) for d in range(size, 2 * size) if (x[b * size:(b + 1) * size] == x[b * size + d:(b + 1) * size + d]).all()}
    for primes in (periodic.PRIMES[:2], periodic.PRIMES):
        assert set(zip(*map(np.ndarray.tolist, periodic._zeros(x, np.arange(60), size, primes)))) == want


def test_long_texts_cost_no_square_of_their_length(spark):
    unary, steps = "a " * 400_000, "a " * 60_000 + "b " + "a " * 60_000
    docs = spark.createDataFrame([(1, unary), (2, steps)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(docs).collect()}
    assert got == {1: [(0, 400_000, 1)], 2: [(0, 60_000, 1), (60_001, 60_000, 1)]}
