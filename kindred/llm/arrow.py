"""Arrow batches inside a task: bounded pieces of text columns, runs of equal keys, building output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 500_000


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of text each; one row may be longer."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        floor = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, floor + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets into them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by a key without nulls; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if held and keys[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = keys[start]
    if held:
        yield pa.Table.from_batches(held)


def packed_words(column: pa.Array, inside: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All runs of bytes that `inside` (256 booleans) allows, and where each text's runs start (one more entry than texts).

    With `lower`, A to Z are lower-cased. Runs do not span texts.
    """
    data, bounds = text_bytes(column)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(bounds), np.int64)
    within = inside[data]
    starts = within.copy()
    starts[1:] &= ~within[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    starts[heads] = within[heads]
    starts = np.flatnonzero(starts)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(within, out=kept[1:])
    packed = data[within]
    if lower:
        packed = packed + ((packed >= 65) & (packed <= 90)).astype(np.uint8) * np.uint8(32)
    offsets = np.append(kept[starts], kept[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words, np.searchsorted(starts, bounds)
