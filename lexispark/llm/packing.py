"""Numpy arrays as compressed binary columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(a: np.ndarray) -> bytes:
    """Byte planes, so that equal high bytes lie together; the item size leads."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return bytes([a.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    planes = raw.reshape(data[0], len(raw) // data[0])
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def gaps(a: np.ndarray) -> bytes:
    """Ascending unsigned numbers as their differences."""
    steps = np.diff(a, prepend=a.dtype.type(0))
    return pack(steps if len(steps) and steps.max() >= 1 << 32 else steps.astype(np.uint32))


def sums(data: bytes) -> np.ndarray:
    """What gaps() packed."""
    return np.cumsum(unpack(data, np.uint32 if data[0] == 4 else np.uint64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give freed memory back to the system: Python workers live on, and glibc and Arrow would keep it for them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over a task's batches; what it held goes back to the system at the task's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole
