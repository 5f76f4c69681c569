"""Arrow batches of bounded size: what kernels share so that their memory does not grow with texts or tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that a kernel works on at once; its arrays take some tens of times as much.
PIECE = 1 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column, and where each row begins; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and len(column) else np.zeros(0, np.uint8), at - at[0]


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a text column as code points, and where each row begins: bytes where all are ASCII."""
    data, at = flat(column)
    if data.max(initial=0) < 128:
        return data, at
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), first[at]


def texts(codes: np.ndarray, at: np.ndarray) -> pa.Array:
    """Inverse of ``symbols``."""
    if codes.dtype == np.uint8:
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(codes))).cast(pa.string())
    return pa.array([codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(at[:-1], at[1:])], pa.string())


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))]).cast(pa.binary())


def sliced(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, one row at least."""
    most = most or PIECE
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > 2 * most:
            yield from sliced(part, most)
        else:
            yield part


def by_pieces(kernel: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """A kernel on whole columns that sees slices of them, each row with all of its text."""

    def run(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))])
        made = [kernel(*part.columns) for part in sliced(batch)]
        return pa.concat_arrays(made) if made else kernel(*columns)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows, which come sorted by a number ``key``, in batches of about ``most`` bytes that hold whole groups."""
    held: list[pa.RecordBatch] = []
    size, most = 0, most or PIECE

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for part in (part for b in batches for part in sliced(b, most)):
        held.append(part)
        size += part.nbytes
        last = part.column(key)[-1].as_py()
        if size >= most and held[0].column(key)[0].as_py() != last:
            every = joined()
            end = int(np.searchsorted(every.column(key).to_numpy(), last))
            yield every.slice(0, end)
            held = [every.slice(end)]
            size = held[0].nbytes
    if held:
        yield joined()


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an array of numbers from 0 on, and how often each occurs."""
    if len(key) and int(key.max()) < 4 * len(key) + (1 << 16):
        n = np.bincount(key)
        found = np.flatnonzero(n)
        return found, n[found]
    return np.unique(key, return_counts=True)
