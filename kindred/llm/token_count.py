"""Token counts of a byte-pair vocabulary by heap and linked list, without making identifiers.

A word starts as a linked list of symbols (its bytes, the last one carrying the end-of-word mark).
A heap holds the adjacent pairs that have a merge, by rank, then place. The lowest is popped; if its
two symbols are still adjacent they become one and the pairs on both sides enter the heap. The
word's count is its initial symbols minus the merges done.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import arrow
from kindred.llm.vocabulary import ChunkTable, word_vocabulary


class MergeCounter:
    """Counts of single words under a vocabulary's merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model["end_of_word_suffix"]
        numbers: dict[str, int] = {}
        for token in model["vocab"]:
            numbers.setdefault(token, len(numbers))
        self.numbers = numbers
        # By pair of symbol numbers, as one integer: rank and the number of the merged symbol.
        self.merges = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            self.merges[numbers[a] << 32 | numbers[b]] = (rank, numbers[a + b])

    def count(self, symbols: str) -> int:
        """Tokens of one word, given as the printable characters of its bytes."""
        numbers, merges = self.numbers, self.merges
        ids = [numbers[c] for c in symbols[:-1]]
        ids.append(numbers[symbols[-1] + self.suffix])
        n = left = len(ids)
        heap = []
        for i in range(n - 1):
            found = merges.get(ids[i] << 32 | ids[i + 1])
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        if not heap:
            return n
        heapify(heap)
        following = list(range(1, n + 1))
        previous = list(range(-1, n - 1))
        while heap:
            _, i, a, b, merged = heappop(heap)
            j = following[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            left -= 1
            k = following[i] = following[j]
            if k < n:
                previous[k] = i
                found = merges.get(merged << 32 | ids[k])
                if found:
                    heappush(heap, (found[0], i, merged, ids[k], found[1]))
            h = previous[i]
            if h >= 0:
                found = merges.get(ids[h] << 32 | merged)
                if found:
                    heappush(heap, (found[0], h, ids[h], merged, found[1]))
        return left


@lru_cache(maxsize=1)
def _table(path: str) -> ChunkTable:
    """Counts of chunks, kept while the Python worker lives."""
    vocabulary, counter = word_vocabulary(path), MergeCounter(path)
    return ChunkTable(lambda chunk: sum(map(counter.count, vocabulary.words(chunk))))


def _counts(path: str, limit: int):
    def run(batches):
        vocabulary, table = word_vocabulary(path), _table(path)
        for batch in batches:
            for part in arrow.pieces(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                n = [sum(map(table.__getitem__, chunks)) + len(specials)
                     for chunks, specials in map(vocabulary.chunks, texts.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()),
                     pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row of `docs` (doc_id, text).

    Counts equal the length of the identifiers the library of `path` (a file of that library with
    byte-level pairs and an end-of-word mark) gives without added special tokens; its special strings
    inside texts count as one each. Null and empty texts have 0 bytes and 0 tokens. Every row
    gives one row, repeated and null ids included; other columns are ignored. No shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(_counts(path or public_tokenizers.path("word_bpe_49k.json"), limit),
                           "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
