"""Words of texts as numbers, for operators that work on arrays of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 texts of an Arrow column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def words_of(text: bytes, lower: bool = False) -> list[bytes]:
    """Maximal stretches without the bytes 0x20 and 0x09-0x0D (which
    ``bytes.split`` takes as white space)."""
    return (text.translate(LOWER) if lower else text).split()


def number(words: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """A number per word and the distinct words: ``distinct[number]``."""
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``begin[k], begin[k] + 1, ...``: ``sizes[k]`` numbers for every k, in order."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
