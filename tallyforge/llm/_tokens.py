"""Token ids of texts in numpy batches, equal to the tokenizers library's.

For the word-level BPE of ``word_bpe_49k.json`` (its rules are checked, not
assumed) a text splits into pieces at byte classes: letter runs, single digits,
sign runs and English contractions. Each distinct piece of a slice is encoded
once, by a compiled BPE over the file's own vocabulary, and kept in a bounded
cache. Texts with anything else (letters beyond Latin-1, control characters, the
special tokens' own strings), and all texts under other tokenizer files, go to
the library whole. Tests hold both ways against the library.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallyforge.llm import _words

SLICE_BYTES = 4 << 20
#: The rules under which pieces can be found by byte class.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

_ALL = np.arange(256)
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)] = _LETTER
_CLASS[(_ALL >= 0x30) & (_ALL <= 0x39)] = _DIGIT
_CLASS[~_words.SPACED] = 0
_CONTROL = (_ALL < 0x20) & _words.SPACED | (_ALL == 0x7F)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (a public convention)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    def __init__(self, path: str, most: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library, self.most, self.known, self.bpe = Tokenizer.from_file(path), most, {}, None
        if self._by_class(spec):
            import tiktoken

            byte_of = _byte_of()
            # The end of a word is a byte that UTF-8 never has.
            ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): i for t, i in spec["model"]["vocab"].items() if not t.startswith("<|")}
            self.bpe = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = {x["content"].encode()[:2] for x in spec.get("added_tokens", [])}

    @staticmethod
    def _by_class(spec: dict) -> bool:
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
        model = spec["model"]
        return (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and not spec.get("post_processor")
            and split[0].get("pattern") == {"Regex": _PATTERN} and split[0].get("behavior") == "Removed" and split[0].get("invert")
            and split[1].get("type") == "ByteLevel" and not split[1].get("add_prefix_space") and not split[1].get("use_regex")
            and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        )

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _encoded(self, hashes: list[int], data: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
        out, get = [], self.known.get
        for h, a, b in zip(hashes, starts, ends, strict=True):
            ids = get(h)
            if ids is None:
                ids = np.array(self.bpe.encode_single_piece(data[a:b] + b"\xff"), "<u4").tobytes()
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[h] = ids
            out.append(ids)
        return out

    def slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of some documents, and where each document's begin."""
        n_docs = len(bounds) - 1
        if self.bpe is None:
            each = [self.whole(data[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        low = _words.LOWER[data]
        lead = np.flatnonzero(low == 0xC3)
        second = low[np.minimum(lead + 1, len(low) - 1)] if len(lead) else lead
        fine = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        low[lead[fine & (second <= 0x9E)] + 1] += 0x20
        odd = low >= 0x80
        odd[lead[fine]] = odd[lead[fine] + 1] = False
        odd |= _CONTROL[low]
        slow = _words.over(bounds, odd, np.logical_or, False)
        text = data.tobytes()
        for mark in self.special:
            at = text.find(mark)
            while at >= 0:
                slow[np.searchsorted(bounds, at, "right") - 1] = True
                at = text.find(mark, at + 1)
        kind = _CLASS[low]
        if slow.any():
            kind[np.repeat(slow, np.diff(bounds))] = 0
        before = np.zeros_like(kind)
        before[1:] = kind[:-1]
        before[bounds[:-1][bounds[:-1] < len(kind)]] = 0
        begins = (kind != 0) & ((kind != before) | (kind == _DIGIT))
        self._contract(low, kind, begins, bounds)
        starts = np.flatnonzero(begins)
        goes_on = np.zeros(len(kind) + 1, bool)
        goes_on[:-1] = (kind != 0) & ~begins
        ends = np.flatnonzero((kind != 0) & ~goes_on[1:]) + 1
        part = _words.Words(0, low, bounds, starts, ends, np.searchsorted(starts, bounds))
        hashes, first, at = np.unique(part.hashes(), return_index=True, return_inverse=True)
        pieces = self._encoded(hashes.tolist(), low.tobytes(), starts[first].tolist(), ends[first].tolist())
        n = np.array([len(x) for x in pieces], np.int64) // 4
        flat, begin = np.frombuffer(b"".join(pieces), "<u4"), np.concatenate([[0], np.cumsum(n)])
        own = n[at]
        ends_at = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat(begin[at] - ends_at[:-1], own) + np.arange(ends_at[-1])] if len(own) else np.zeros(0, np.uint32)
        of = ends_at[part.of]
        if slow.any():
            each = [self.whole(text[bounds[d] : bounds[d + 1]]) if slow[d] else ids[of[d] : of[d + 1]] for d in range(n_docs)]
            return np.concatenate(each).astype(np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids.astype(np.uint32), of

    @staticmethod
    def _contract(low: np.ndarray, kind: np.ndarray, begins: np.ndarray, bounds: np.ndarray) -> None:
        """A lone apostrophe takes the s, t, m, d, re, ve or ll that follows it."""
        at = np.flatnonzero((low[:-1] == 0x27) & begins[:-1] & (kind[:-1] == _SIGN) & (kind[1:] == _LETTER) & begins[1:]) if len(low) > 1 else np.zeros(0, np.int64)
        at = at[~np.isin(at + 1, bounds)]
        if not len(at):
            return
        one = low[at + 1]
        after = np.minimum(at + 2, len(low) - 1)
        two = np.where((at + 2 < len(low)) & (kind[after] == _LETTER) & ~begins[after], low[after], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        took = np.where(short, 1, np.where(long, 2, 0))
        at, took = at[took > 0], took[took > 0]
        begins[at + 1] = False
        rest = at + 1 + took
        rest = rest[rest < len(low)]
        begins[rest[kind[rest] == _LETTER]] = True


@functools.cache
def coder(path: str) -> Coder:
    """One for each worker and file."""
    return Coder(path)


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, where each document's begin), some whole documents at a time."""
    own = coder(path)
    raw, at = _words.buffers(texts)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield first, *own.slice(raw[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last
