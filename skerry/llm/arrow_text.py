"""Arrow text columns as byte arrays, in slices of bounded size, for operators that work inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Classes of UTF-8 bytes.
BLANK, LETTER, DIGIT, PUNCT, WIDE = range(5)
CLASS = np.full(256, WIDE, np.uint8)
for _b in range(128):
    CLASS[_b] = BLANK if _b in b" \t\n\x0b\x0c\r" else LETTER if chr(_b).isalpha() else DIGIT if chr(_b).isdigit() else PUNCT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def sliced(batches: Iterator[pa.RecordBatch], text_at: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of each hold about so many bytes (a longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null: none) end to end, and the n + 1 offsets of the texts in them."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")]).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A string array over the same bytes, one entry from each start to the next."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def starts_of(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions marked as starts, with the start of each text that isn't empty."""
    first = offsets[:-1][np.diff(offsets) > 0]
    mark[first] = True
    return np.flatnonzero(mark)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n + 1 offsets of the texts, counted in pieces."""
    return np.searchsorted(starts, offsets)
