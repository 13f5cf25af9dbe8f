"""Byte-level byte-pair encoding and decoding with the tokenizers library over Arrow batches.

The rank file is turned into a model of that library: every byte is written as its printable
character, and every split of a ranked token into two ranked parts is a merge of its rank, which is
what the ranks alone mean. Matches of the pattern are encoded separately; those seen are kept in a
bounded table. Decoding joins the bytes behind the tokens' characters; characters whose bytes
lie in several tokens are put together again, bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from tokenizers import models

from kindred.llm import arrow
from kindred.llm.vocabulary import WordTable, byte_symbols


class ByteCodec:
    """One rank file and pattern: text to ids and back."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        symbols = byte_symbols()
        self.written = {ord(s): b for b, s in enumerate(symbols)}
        self.as_symbols = {b: s for b, s in enumerate(symbols)}
        written = {token: "".join([symbols[b] for b in token]) for token in ranks}
        merges = [(written[token[:k]], written[token[k:]])
                  for token in sorted(ranks, key=ranks.get)
                  for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        self.model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges)
        self.find = regex.compile(pattern).findall
        self.symbols = symbols
        # Reversed byte table: the characters of a token back to its bytes.
        self.bytes_of = {rank: bytes(self.written[ord(c)] for c in written[token]) for token, rank in ranks.items()}
        self.table = WordTable(self._word)

    def _word(self, word: str) -> bytes:
        text = word.encode().decode("latin-1").translate(self.as_symbols)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.table.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; a character split over tokens belongs to each of them."""
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in array("I", ids)], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return character[starts], character[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteCodec:
    """Built once per Python worker."""
    return ByteCodec(path, pattern)


def _encode(path: str, pattern: str):
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for part in arrow.pieces(batch, "text"):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                ids = [own.encode(t) for t in texts]
                spans = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), arrow.lists([np.frombuffer(i, np.int32) for i in ids], pa.int32()),
                     arrow.lists([s.astype(np.int32) for s, _ in spans], pa.int32()),
                     arrow.lists([e.astype(np.int32) for _, e in spans], pa.int32())],
                    names=["doc_id", "ids", "starts", "ends"])
    return run


def _digests(path: str, pattern: str):
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for part in arrow.pieces(batch, "text"):
                counts, encoded, decoded = [], [], []
                for text in pc.fill_null(part.column("text"), "").to_pylist():
                    ids = own.encode(text)
                    counts.append(len(ids) // 4)
                    encoded.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()),
                                                  pa.array(decoded, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _place(path: str | None) -> str:
    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids, starts, ends (characters, end exclusive, per id) of every row of `docs` (doc_id, text).

    Null and empty texts have empty lists. Every row gives one row, repeated and null ids included;
    other columns are ignored. No shuffle.
    """
    return _texts(docs).mapInArrow(_encode(_place(path), pattern), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(ids: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes of an array of ids; null for null. An id that the file does not have is an error."""
    path = _place(path)

    @pandas_udf("binary")
    def run(column):
        own = codec(path, pattern)
        return column.map(lambda x: None if x is None else own.decode(array("I", [int(i) for i in x]).tobytes()))
    return run(ids)


def text_of(data: Column) -> Column:
    """Decoded bytes as text: whole characters, and U+FFFD where a character's bytes are not complete."""
    @pandas_udf("string")
    def run(column):
        return column.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))
    return run(data)


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex) of every row, encoded and decoded in one pass.

    The ids are hashed as little-endian unsigned 32-bit integers, the decoded bytes as they are. Rows are
    treated as in `encode`.
    """
    return _texts(docs).mapInArrow(_digests(_place(path), pattern),
                                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
