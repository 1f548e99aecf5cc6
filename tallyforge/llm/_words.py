"""Word tables of Arrow text columns, computed with numpy inside Spark tasks.

A batch's texts are one byte buffer with offsets. Words are runs of bytes from
a byte class, so a class over code points such as "not white space" is exact on
UTF-8. Nulls count as empty texts. Work is cut into slices of whole documents,
so memory follows the slice and the longest text, never the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_ALL = np.arange(256)
#: Bytes of words that only white space (0x20, 0x09-0x0D) divides.
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes of words of digits, lower-case letters and everything beyond ASCII.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: Runs of letters and digits (1) and runs of signs (2), as tokens of their own.
PUNCT = np.where(SPACED, 2, 0).astype(np.uint8)
PUNCT[ALNUM | ((_ALL >= 0x41) & (_ALL <= 0x5A))] = 1
#: Lower-cases A-Z only.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of some whole documents.

    ``of`` has a document's first word at index d and its end at d + 1;
    ``first`` is the row of the batch that document 0 stands for.
    """

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.of))

    def hashes(self) -> np.ndarray:
        """64 bits per word; words of up to 8 bytes never collide."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        n = self.ends - self.starts
        out = mix((eight[self.starts] & _MASKS[np.minimum(n, 8)]) + _U(0x9E3779B97F4A7C15))
        at, rest = np.flatnonzero(n > 8), 8
        while len(at):
            left = n[at] - rest
            piece = eight[self.starts[at] + rest] & _MASKS[np.minimum(left, 8)]
            out[at] = mix(out[at] * _U(0x9E3779B97F4A7C15) + piece + left.astype(np.uint64))
            at, rest = at[left > 8], rest + 8
        return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, word: np.ndarray, *, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of the texts, a few whole documents at a time, in their order."""
    raw, at = buffers(texts)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield words(raw[at[first] : at[last]], at[first : last + 1] - at[first], word, first, lower)
        first = last


def words(data: np.ndarray, bounds: np.ndarray, word: np.ndarray, first: int = 0, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    kind = word[data]
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = 0
    after[bounds[1:][bounds[1:] > 0] - 1] = 0
    inside = kind != 0
    starts = np.flatnonzero(inside & (kind != before))
    return Words(first, data, bounds, starts, np.flatnonzero(inside & (kind != after)) + 1, np.searchsorted(starts, bounds))


def windows(hashes: np.ndarray, of: np.ndarray, size: int, *, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside a document, and where each document's begin.

    With ``short``, a document of fewer words has its whole sequence as one.
    """
    odd = [_U((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1)) for j in range(size)]
    n = np.diff(of)
    runs = np.maximum(n - size + 1, 0)
    whole = max(0, len(hashes) - size + 1)
    every = np.zeros(whole, np.uint64)
    for j in range(size):
        every += hashes[j : j + whole] * odd[j]
    keep = np.ones(whole, bool)
    for back in range(1, size):  # those that would cross into the next document
        ends = of[1:] - back
        keep[ends[(ends >= of[:-1]) & (ends < whole)]] = False
    every = mix(every[keep])
    if short and (few := np.flatnonzero((n > 0) & (n < size))).size:
        own = np.zeros(len(few), np.uint64)
        for j in range(size - 1):
            has = n[few] > j
            own[has] += hashes[of[few[has]] + j] * odd[j]
        own = mix(own + n[few].astype(np.uint64))
        runs = runs.copy()
        starts = np.concatenate([[0], np.cumsum(runs)])
        every = np.insert(every, starts[few], own)
        runs[few] = 1
    return every, np.concatenate([[0], np.cumsum(runs)])


def over(of: np.ndarray, values: np.ndarray, ufunc: np.ufunc, empty) -> np.ndarray:
    """ufunc over each document's values; ``empty`` where it has none."""
    out = np.full(len(of) - 1, empty, values.dtype)
    has = np.flatnonzero(np.diff(of) > 0)
    if len(has):
        out[has] = ufunc.reduceat(values, of[has])
    return out
