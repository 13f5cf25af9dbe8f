"""The source divergence audit against its definition, term by term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import divergence
from kindred.llm.session import prepare

DOCS = "doc_id long, text string, lang string, source string, term string, n int, rank long, grp string"
LOWER = {k: k + 32 for k in range(65, 91)}


def price(n, total, kept):
    return 1 + 10**9 * (n + 1) // (total + kept)


def brute(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: price(n[s][t], sum(n[s].values()), len(kept)) for t in kept} for s in sources}
        q = {t: price(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def corpus(sources, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdéßж" for b in "xyzöλ"] + ["The", "the", "THE", "É", "é", "日本", " z"]
    rows = []
    for k in range(300):
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(sources)}"
        text = "".join(rng.choice(words) + rng.choice([" ", "-", "1", "\n", "_", ". "]) for _ in range(min(400, int(rng.paretovariate(0.7)))))
        rows.append((text, rng.choice(["en", "en", "de", None, ""]), source))
    rows += [(None, "en", "none"), ("", "en", "blank"), ("123 !?", "en", None), ("Rare words", "fr", "a"), (None, "fr", "b"), ("x x x", "it", "one"),
             (None, None, None), ("the " * 20_000, "de", "long")] + [("twice twice", "en", "hot")] * 3 + [("alone alone", "pt", "p")] * 4
    return rows


def table(spark, rows):
    return spark.createDataFrame([(k % 7 or None, *r, "clash", 1, 2, "clash") for k, r in enumerate(rows)], DOCS)


@pytest.mark.parametrize(("rows", "sources"), [(4096, 256), (8, 3), (1000, 1)])
def test_divergence_equals_its_definition(spark, monkeypatch, rows, sources):
    prepare(spark)
    monkeypatch.setattr(divergence, "ROWS", rows)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    given = corpus(9)
    got = sorted(tuple(r) for r in divergence.divergence(table(spark, given), top=15).collect())
    assert got == brute(given, top=15)


def test_no_rows_and_no_terms(spark):
    assert divergence.divergence(table(spark, corpus(2)).limit(0)).collect() == []
    given = [("one", "en", "a"), (None, "en", "b"), ("", "en", "c")]
    got = sorted(tuple(r) for r in divergence.divergence(table(spark, given)).collect())
    assert got == brute(given) and {r[4] for r in got} == {0} and len(got) == 6


@pytest.mark.parametrize("columns", [1, 4, 1024])
def test_cells_price_their_joint_tables_exactly(monkeypatch, columns):
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    rng = np.random.default_rng(columns)
    held = [(row, g, int(rng.integers(1, 6))) for row in range(60) for g in rng.permutation(5)[:rng.integers(1, 6)]]
    row, grp, n = (np.array(c) for c in zip(*held))
    p, nil = n * 10**8 // (grp + 1) + 1, 7 * grp + 1
    for side in (np.full(len(row), 2), (grp > 2).astype(int)):
        entries = pa.table({"cell": np.zeros(len(row), int), "row": row, "grp": grp, "n": n, "p": p, "nil": nil, "side": side.astype(np.int32)})
        got = {(r["g"], r["h"]): r["value"] for r in divergence._cell(entries).to_pylist()}
        want = Counter()
        for i in range(len(row)):
            for j in range(len(row)):
                if row[i] == row[j] and grp[i] != grp[j] and (side[i] == 2 or side[i] != side[j]):
                    a, b, x, y = (int(v) for v in (p[i], p[j], nil[i], nil[j]))
                    want[int(grp[i]), int(grp[j])] += (a - b)**2 // b - (a - y)**2 // y - (x - b)**2 // b + (x - y)**2 // y
        assert got == {k: v for k, v in want.items() if v}
