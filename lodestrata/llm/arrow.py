"""Plumbing of the operators that work on Arrow batches in Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Characters that are held as arrays at once; one longer text is worked on alone.
CHARS_AT_ONCE = 400_000


def pieces(batch: pa.RecordBatch, column: str, chars: int = CHARS_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batch with about ``chars`` characters in ``column``, and those texts (null: empty)."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > chars:
            yield batch.slice(start, i - start), texts[start:i]
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def code_points(texts: Iterable[str], between: str = "\n\x00\n") -> np.ndarray:
    """The texts' code points in one array, with ``between`` after each text."""
    joined = "".join(t + between for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list array of consecutive ``lengths`` of ``values``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
