"""Terms of texts as Arrow strings: maximal runs of the bytes of a class, A-Z lower-cased.

A class that holds all bytes from 0x80 on and some ASCII characters takes whole code points, so runs of
bytes are runs of characters.  A text's terms are cut from one contiguous buffer, without an object a term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import text_buffer

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(ascii_letters: str) -> np.ndarray:
    """Marks the given ASCII characters and all bytes of other characters."""
    out = np.zeros(256, dtype=bool)
    out[128:] = True
    out[[ord(c) for c in ascii_letters]] = True
    return out


_ABC = "abcdefghijklmnopqrstuvwxyz"
LETTERS = byte_class(_ABC + _ABC.upper())
ALNUM = byte_class(_ABC + _ABC.upper() + "0123456789")


def split_terms(column: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one after the other, and where each text's begin (one more entry than texts); null is empty."""
    data, offsets = text_buffer(column)
    member = inside[data]
    begin, end = member.copy(), member.copy()
    begin[1:] &= ~member[:-1]
    end[:-1] &= ~member[1:]
    filled = offsets[1:] > offsets[:-1]
    at = offsets[:-1][filled]
    begin[at] = member[at]
    at = offsets[1:][filled] - 1
    end[at] = member[at]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    packed = _LOWER[data[member]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(packed))
    return terms, np.searchsorted(starts, offsets)
