"""The words of many texts at once, as codes into a dictionary of the distinct ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes as they are, with A-Z in lower case.
LOWER = bytes(range(256)).lower()
#: The same, with a space in place of every ASCII character but letters and digits.
LOWER_ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER)


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """texts (strings without nulls) with each byte replaced by that of the table, which leaves bytes over 0x7F alone."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    held = bytes(memoryview(data)[at[0] : at[-1]]).translate(table) if data is not None else b""
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(held)])


def coded_words(texts: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of all texts, one after the other; the distinct words; and how many words each text has. A word is a run
    without ASCII white space, after the bytes were replaced by table."""
    split = pc.ascii_split_whitespace(texts if table is None else translated(texts, table))
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    held = real[codes] if len(codes) else np.zeros(0, bool)
    n = np.diff(np.append(0, np.cumsum(held))[offsets - offsets[0]])
    return codes[held], coded.dictionary, n
