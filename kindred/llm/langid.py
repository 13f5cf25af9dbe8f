"""Language identification by hierarchical discrimination.

Linear support vector machines tell language families apart first, one against one; within the
predicted family one machine per pair of languages decides, and the language with most votes wins
(equal votes: the larger sum of margins). Where more than BRANCH families are to be told apart, those with alike mean
features are put together first, so that machines grow with the languages and not with their square. Features are hashed counts of letter n-grams of one to
three characters, with any run of non-letters as one boundary.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import arrow
from kindred.llm.shingles import mix
from kindred.llm.vocabulary import released

DIMS = 4096
ROWS = 128
BRANCH = 8
# Languages by family; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa", "gu"],
    "semitic": ["ar", "he", "am", "mt"],
    "turkic": ["tr", "az", "kk", "uz"],
    "uralic": ["fi", "et", "hu"],
    "baltic": ["lt", "lv"],
}

_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector per text, and whether it has letters. A text's vector does not depend on the others."""
    part = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(part)), [len(t) for t in part])
    letter = _LETTER[code]
    code = np.where(letter, code, 0)
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    code, doc, letter = code[keep].astype(np.uint64), doc[keep], letter[keep]
    counts = np.zeros(len(part) * DIMS)
    hashed = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        hashed = mix(hashed[:len(code) - n + 1] + code[n - 1:] * np.uint64(2 * n + 1) + np.uint64(n))
        same = doc[:len(hashed)] == doc[n - 1:]
        same &= (code[:len(hashed)] > 0) | (code[n - 1:] > 0)
        slot = doc[:len(hashed)][same] * DIMS + (hashed[same] % np.uint64(DIMS)).astype(np.int64)
        counts += np.bincount(slot, minlength=len(counts))
    rows = np.sqrt(counts.reshape(len(part), DIMS))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norm > 0, norm, 1)).astype(np.float32), np.bincount(doc[letter], minlength=len(part)) > 0


@released
def _blocks(batches):
    """Rows in blocks of at most ROWS, with their features; null texts as empty ones."""
    for batch in batches:
        for part in arrow.pieces(batch, "text"):
            for start in range(0, part.num_rows, ROWS):
                block = part.slice(start, ROWS)
                yield block, *features(pc.fill_null(block.column("text").cast(pa.large_string()), "").to_pylist())


def svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, classes weighted alike, by accelerated descent."""
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    bias = ahead_bias = np.float32(0)
    rate = np.float32(1 / (4 + penalty))
    for t in range(steps):
        push = weight * y * np.maximum(0, 1 - y * (x @ ahead + ahead_bias))
        new, new_bias = ahead + rate * (2 * (push @ x) - np.float32(penalty) * ahead), ahead_bias + rate * 2 * push.sum()
        speed = np.float32(t / (t + 3))
        ahead, ahead_bias = new + speed * (new - w), new_bias + speed * (new_bias - bias)
        w, bias = new, new_bias
    return w.astype(np.float64), float(bias)


def _alike(means: np.ndarray, k: int) -> np.ndarray:
    """Which of k groups each row belongs to, by nearest centroid: seeds farthest from each other, then some rounds."""
    seeds, far = [int(np.argmax(((means - means.mean(0)) ** 2).sum(1)))], None
    while len(seeds) < k:
        apart = ((means - means[seeds[-1]]) ** 2).sum(1)
        far = apart if far is None else np.minimum(far, apart)
        seeds.append(int(far.argmax()))
    centres = means[seeds].copy()
    for _ in range(10):
        group = np.argmin([((means - c) ** 2).sum(1) for c in centres], 0)
        for j in set(group):
            centres[j] = means[group == j].mean(0)
    # Equal rows cannot be told apart: deal them out.
    return group if len(set(group)) > 1 else np.arange(len(means)) % k


class Branch:
    """Children (a language's name or a further branch each) and a machine for each two of them."""

    def __init__(self, x: np.ndarray, names: np.ndarray, children: list[list[str]]):
        """`children` are lists of languages: one family each."""
        if len(children) > BRANCH:
            means = np.stack([x[np.isin(names, c)].mean(0) for c in children])
            group = _alike(means, BRANCH)
            children = [[c for c, g in zip(children, group, strict=True) if g == j] for j in sorted(set(group))]
        else:
            children = [[c] for c in children]
        self.children, self.machines, rows = [], {}, []
        for families in children:
            langs = [v for family in families for v in family]
            rows.append(np.isin(names, langs))
            if len(langs) == 1:
                self.children.append(langs[0])
            else:
                own = rows[-1]
                self.children.append(Branch(x[own], names[own], families if len(families) > 1 else [[v] for v in langs]))
        for i, j in combinations(range(len(children)), 2):
            both = rows[i] | rows[j]
            w, bias = svm(x[both], rows[i][both])
            self.machines[i, j] = w.astype(np.float32), bias

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winning child, and the smallest chance it has against any other."""
        k = len(self.children)
        margins = np.zeros((len(x), k, k))
        for (i, j), (w, bias) in self.machines.items():
            margins[:, i, j] = x @ w + bias
            margins[:, j, i] = -margins[:, i, j]
        votes = (margins > 0).sum(2)
        order = votes + 0.5 * np.tanh(margins.sum(2) / max(1, k))
        best = order.argmax(1)
        won = margins[np.arange(len(x)), best]
        won[np.arange(len(x)), best] = np.inf
        return best, 1 / (1 + np.exp(-3 * np.clip(won.min(1), -50, 50))) if k > 1 else np.ones(len(x))

    def predict(self, x: np.ndarray, lang: np.ndarray, score: np.ndarray, rows: np.ndarray) -> None:
        """Fill in the language and score of some rows."""
        best, chance = self.choose(x[rows])
        score[rows] *= chance
        for k, child in enumerate(self.children):
            mine = rows[best == k]
            if len(mine) and isinstance(child, Branch):
                child.predict(x, lang, score, mine)
            else:
                lang[mine] = child

    def count(self) -> int:
        """The machines of this branch and all below."""
        return len(self.machines) + sum(c.count() for c in self.children if isinstance(c, Branch))


class Model:
    """The machines of the families and of the languages within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs, object)
        families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            families.setdefault(family_of(lang), []).append(lang)
        children = [families[f] for f in sorted(families)]
        self.root = Branch(x, names, children if len(children) > 1 else [[v] for v in children[0]])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        lang, score = np.empty(len(x), object), np.ones(len(x))
        self.root.predict(x, lang, score, np.arange(len(x)))
        return lang, score


def _learned(batches):
    for block, x, lettered in _blocks(batches):
        yield pa.RecordBatch.from_arrays([block.column("lang"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(lettered)],
                                         names=["lang", "x", "lettered"])


def fit(labelled: DataFrame, per_lang: int = 400, most: int = 2500, labels: int = 1000) -> Model | None:
    """Learn from rows (doc_id, text, lang); null texts and labels are left out. None if nothing is left.

    The machines are fitted on a sample chosen by a hash of doc_id and text, repeated rows counted once: about `per_lang` rows
    of each language and about `most` in all, at least about one a language (more only by chance), of the `labels` languages
    with most documents. That bounds what reaches the driver.
    """
    labelled = labelled.select(F.xxhash64("doc_id", "text", F.lit(3)).alias("key"), F.col("text").cast("string"), F.col("lang").cast("string")).dropna(subset=["text", "lang"])
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "lang").limit(labels)
    counts = [(r["lang"], r["n"]) for r in counts.collect()]
    if not counts:
        return None
    want = min(per_lang, max(1, most // len(counts)))
    shares = labelled.sparkSession.createDataFrame([(lang, min(1.0, want / max(1, n))) for lang, n in counts], "lang string, share double")
    sample = (labelled.join(F.broadcast(shares), "lang").where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30))
              .dropDuplicates(["key", "lang"]))
    rows = sample.select("text", "lang").mapInArrow(_learned, "lang string, x binary, lettered boolean").where("lettered").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["x"]))
    return Model(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows])


def _verdicts(shared, x: np.ndarray, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lang, score = np.full(len(x), "und", object), np.zeros(len(x))
    if shared.value is not None and lettered.any():
        lang[lettered], score[lettered] = shared.value.predict(x[lettered])
    return lang, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row of `docs` (doc_id, text) from its whole text alone.

    A null text or one without letters is `und` with score 0, as is any text if nothing was learned. Repeated rows and
    null ids are rows like others; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block, x, lettered in _blocks(batches):
            lang, score = _verdicts(shared, x, lettered)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])
    return (docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double"))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs` (text, lang, any others) that have a language, whole, with lang as predicted. No shuffle.

    Rows whose prediction is `und` go: null texts and texts without letters. If nothing was learned, rows with letters keep their lang.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("lang")

    def run(batches):
        for block, x, lettered in _blocks(batches):
            if shared.value is not None:
                lang, _ = _verdicts(shared, x, lettered)
                block = block.set_column(at, block.schema.field(at), pa.array(lang, pa.string()).cast(block.schema.types[at]))
            yield block.filter(pa.array(lettered))
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Documents never learned from: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out and have a lang."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
