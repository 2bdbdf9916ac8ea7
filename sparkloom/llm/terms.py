"""Words of whole texts on Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are worked on at once; a longer text is worked on alone.
BYTES_AT_ONCE = 1 << 21


def in_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of texts."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, most + (upto[start - 1] if start else 0), "right")))
            yield batch.slice(start, stop - start)
            start = stop


def splitter(separators: str) -> np.ndarray:
    """A byte for each byte: a space for ASCII characters that the pattern names, A-Z in lower case, others as they are."""
    import re

    pattern, table = re.compile(separators), np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for i in range(128):
        if pattern.match(chr(table[i])):
            table[i] = 32
    return table


def words(texts: pa.Array, table: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all words of all texts, number of words of each); null has none. table: of splitter()."""
    own = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int32)
    data = own.buffers()[2]
    plain = table[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.uint8)
    split = pc.ascii_split_whitespace(pa.BinaryArray.from_buffers(pa.string(), len(own), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)]))
    every = split.flatten()
    kept = pc.not_equal(pc.binary_length(every), 0)  # at the ends of a text there may be empty ones
    edges = np.r_[0, np.cumsum(kept.to_numpy(zero_copy_only=False), dtype=np.int64)][np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)]]
    return every.filter(kept).dictionary_encode(), np.diff(edges)
