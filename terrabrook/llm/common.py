"""What the operators of this subpackage share: scratch tables, batches of bounded size, ragged copies."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators.scratch import saved, scratch_path  # noqa: F401

#: Bytes of text that one numpy step works on; the arrays it makes are some 40 times as large.
STEP_BYTES = 1 << 20

_C = ctypes.CDLL(None)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def extended(docs: DataFrame, text: str, run: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], more: dict[str, str]) -> DataFrame:
    """docs with further columns (name: type) that `run` puts behind those of its batches; it is given the place of `text`. Columns go by place, so any names will do."""
    at, names = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns) + len(more))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches, at):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    kinds = [*(t for _, t in docs.dtypes), *more.values()]
    out = docs.toDF(*names[: len(docs.columns)]).mapInArrow(renamed, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))
    return out.toDF(*docs.columns, *more)


def utf8(column: pa.Array) -> pa.Array:
    """Text as binary with 64-bit offsets; null becomes empty."""
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a large_binary column without nulls."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if n and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], data


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer row is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def stepwise(batches: Iterator[pa.RecordBatch], name: str | int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches as slices of about `most` bytes of a text or binary column, by rows. What Arrow and the C library hold beyond them goes back to the system after each
    batch, so that a worker that Spark keeps for later stages stays small."""
    for batch in batches:
        column = batch.column(name)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in steps(np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes))), most):
            yield batch.slice(a, b - a)
        del batch, column
        give_back()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_C, "malloc_trim", None)) is not None:
        trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of every i, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as it takes to be none of the taken names (which differ in more than case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def cut_words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """(start, row, word) of the longest runs of bytes that a table of 256 has inside; rows are data[at[i] : at[i + 1]], and no run crosses their ends. A-Z lower-cased."""
    word, begins = inside[data], np.zeros(len(data) + 1, bool)
    begins[at[:-1]] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:-1]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(np.cumsum(word, dtype=np.int64)[starts] - 1, np.count_nonzero(word)))
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    body = data[word].tobytes().translate(_LOWER)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
    return starts, np.searchsorted(at, starts, "right") - 1, words
