"""Best-fit packing of token sequences by hierarchical rounds.

A document's pieces are items. In a round the items are dealt over tasks; each task packs its own
by best fit, longest first. Bins with at most SLACK free tokens are final. The others become items of the next
round, as long as what they hold, dealt anew by another hash, so that bins of several tasks meet. In
every round a task has about one task's worth of items; the last round has one task. A round that no longer
lowers the number of open bins by one in a hundred ends the work, since what is left hardly fits together.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import arrow
from kindred.llm.vocabulary import ChunkTable, forget, word_vocabulary
from kindred.session import store

TASK_ITEMS = 100_000
SLACK = 2


@lru_cache(maxsize=1)
def _table(path: str) -> ChunkTable:
    """Ids of chunks as bytes, kept while the Python worker lives."""
    vocabulary = word_vocabulary(path)
    tokenize = vocabulary.tokenizer.model.tokenize
    return ChunkTable(lambda chunk: array("I", [t.id for w in vocabulary.words(chunk) for t in tokenize(w)]).tobytes())


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches):
        vocabulary, table = word_vocabulary(path), _table(path)
        forget(but=table)  # what the stages before this one left in the worker
        closing = array("I", [end]).tobytes()
        for batch in batches:
            for part in arrow.pieces(batch, "text"):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, text in enumerate(pc.fill_null(part.column("text"), "").to_pylist()):
                    tokens = []
                    for chunks, special in vocabulary.segments(text):
                        tokens += map(table.__getitem__, chunks)
                        if special is not None:
                            tokens.append(array("I", [special]).tobytes())
                    tokens.append(closing)
                    data = b"".join(tokens)
                    for k, at in enumerate(range(0, len(data), 4 * size)):
                        cut = data[at:at + 4 * size]
                        rows.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        ids.append(cut)
                out = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(arrow.lists([np.frombuffer(x, np.uint32).astype(np.int32) for x in ids], pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def token_pieces(docs: DataFrame, path: str | None = None, size: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every row of `docs` (doc_id, text).

    A document's ids are those of the tokenizers library without added special tokens, then `end`.
    Only documents of more than `size` ids are cut. Null and empty texts are the single id `end`.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_pieces(path or public_tokenizers.path("word_bpe_49k.json"), size, end, with_ids), schema)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin that still takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    # Bins by free space; bit f of `free` is set while a bin with f free tokens exists.
    by_space: list[list[int]] = [[] for _ in range(size + 1)]
    free = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = free >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                free &= ~(1 << space)
        else:
            space, b = size, made
            made += 1
        bins[i], offsets[i] = b, size - space
        if space > n:
            by_space[space - n].append(b)
            free |= 1 << (space - n)
    return bins, offsets


def _pack(size: int, number: int):
    """Best fit of each run of one `task`: where every item lies in its bin, and how full that is."""
    def run(batches):
        for rows in arrow.runs(batches, "task"):
            task = rows.column("task")[0].as_py()
            lengths = rows.column("length").to_numpy()
            bins, offsets = best_fit(lengths, size)
            filled = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
            yield pa.RecordBatch.from_arrays(
                [rows.column("item").combine_chunks(), pa.array((number << 56) + (task << 32) + bins), pa.array(offsets), pa.array(filled)],
                names=["item", "bin", "offset", "filled"])
    return run


def pack(items: DataFrame, size: int = 2048, task_items: int = TASK_ITEMS) -> DataFrame:
    """(item, sequence_id, offset) of every row of `items` (item: distinct longs from 0, length: 1 to size).

    Sequences are filled without gaps from 0 and hold at most `size`. The dealing depends on the
    items alone, so a lost task packs the same again. Each round is written to the shared folder;
    only its counts reach the driver.
    """
    full = items.where(F.col("length") >= size).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    # Each item as member of a bin: `bin` names the open bin that holds it, `inner` its place there.
    level = items.where(F.col("length") < size).select("item", "length")
    placed, done, number = None, [], 0
    count = level.count()
    tasks = max(1, -(-count // task_items))
    while count:
        dealt = (level.withColumn("task", F.expr(f"pmod(xxhash64(item, {number}), {tasks})"))
                 .repartition(max(1, tasks), "task").sortWithinPartitions("task", "length", "item"))
        fits = store(dealt.mapInArrow(_pack(size, number), "item long, bin long, offset long, filled long"), "packed")
        ended = fits.agg(F.countDistinct("bin"), F.count_distinct(F.when(F.col("filled") < size - SLACK, F.col("bin")))).first()
        last = tasks == 1 or ended[1] > 0.99 * count
        if placed is None:
            placed = fits.select("item", "bin", F.col("offset").alias("inner"), "filled")
        else:
            outer = fits.select(F.col("item").alias("bin"), F.col("bin").alias("outer"), F.col("offset").alias("shift"), "filled")
            placed = placed.drop("filled").join(outer, "bin").select("item", F.col("outer").alias("bin"),
                                                                     (F.col("inner") + F.col("shift")).alias("inner"), "filled")
        placed = store(placed, "placed")
        closed = F.lit(True) if last else F.col("filled") >= size - SLACK
        done.append(placed.where(closed).select("item", F.col("bin").alias("sequence_id"), F.col("inner").alias("offset")))
        if last:
            break
        placed = placed.where(~closed)
        level = fits.where(F.col("filled") < size - SLACK).select(F.col("bin").alias("item"), F.col("filled").alias("length")).distinct()
        count, number = ended[1], number + 1
        tasks = max(1, -(-count // task_items))
    for part in done:
        full = full.unionAll(part)
    return full


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id (long), offset of the pieces of all rows of `docs`.

    Null and empty texts are one piece of one id. Repeated rows and null ids are packed like
    others, each row by itself. Extra columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    pieces = store(token_pieces(docs, path, size).withColumn("unit", F.monotonically_increasing_id()), "pieces")
    places = pack(pieces.select(F.col("unit").alias("item"), "length"), size)
    return (pieces.join(places.withColumnRenamed("item", "unit"), "unit")
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
