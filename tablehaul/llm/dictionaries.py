"""Texts in slices of some megabytes whose words are numbered by a dictionary of their own.

A slice numbers its words as it meets them. Its dictionary goes beside it as rows, which meet the words that matter to
all slices by a shuffle, so no task and no broadcast holds the words of the corpus: a word is sent once a slice, not once
an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

# Rows with a body are slices, of which each may have several parts; rows with a word are dictionary entries of a part.
# In the former, local and count are sums over the slice.
CODED = "slice long, part string, body binary, local int, word string, count long"
_NAMES = [c.split()[0] for c in CODED.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string(), pa.int64()]


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def slice_numbers() -> Iterator[int]:
    """A number of its own for each slice of a task. They differ between readings of a table, so what is numbered is
    written before it is used twice."""
    number = TaskContext.get().partitionId() << 32
    while True:
        yield number
        number += 1


def squeezed(values: np.ndarray) -> bytes:
    """The values' type, size and bytes, compressed."""
    raw = values.tobytes()
    return values.dtype.str[1:].encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(held: bytes) -> np.ndarray:
    size = int.from_bytes(held[2:10], "little")
    raw = pa.decompress(held[10:], size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(raw, np.dtype(held[:2].decode()))


def coded_batches(
    number: int, part: str | None, body: bytes, numbers: Numbers, counts: np.ndarray, rows: int | None = None, total: int | None = None
) -> Iterator[pa.RecordBatch]:
    """A slice's part, with a number of its rows and one of its words where these are of use, and the entries of its
    dictionary whose count is not 0."""
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((number, part, body, rows, None, total), _KINDS)], names=_NAMES)
    words = pa.array(numbers, pa.binary()).cast(pa.string())
    n = len(words)
    entries = pa.RecordBatch.from_arrays([
        pa.array(np.full(n, number)), pa.array([part] * n, pa.string()), pa.nulls(n, pa.binary()),
        pa.array(np.arange(n, dtype=np.int32)), words, pa.array(counts.astype(np.int64)),
    ], names=_NAMES)
    yield entries.filter(pa.array(counts > 0))
