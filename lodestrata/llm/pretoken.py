"""The word splitting of a lower-casing word-end BPE tokenizer file: special strings, NFC, white space, lower case, then words.

Texts are taken in batches: what stands between blanks is looked up in a `Memo`
by its bytes, what is new is split into words, the distinct words are encoded,
and the ids of texts are gathered by index.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from lodestrata.llm import store

_TOP = 0x250


def _plain_class() -> str:
    """Characters that are in NFC already, whose lower case is one character of the same range, and that str.split() takes for white space as the file does."""
    return "".join(re.escape(chr(c)) for c in range(_TOP) if len(x := chr(c).lower()) == 1 and ord(x) < _TOP and not 0x1C <= c < 0x20) + "‐-‧€"


_PLAIN = re.compile(f"[{_plain_class()}]*")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_TOP) if unicodedata.category(chr(c))[0] == kind)


_SPACE = "\t-\r \x85\xa0"
_FAST = re.compile(f"[{_class('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+")
_LETTERS = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None for b in range(256)]
_spare = (chr(256 + k) for k in range(256))
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on.
BYTE_LETTERS = [x or next(_spare) for x in _LETTERS]
_BYTES = {x: b for b, x in enumerate(BYTE_LETTERS)}


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(text: str) -> bool:
    """Whether text.split() cuts only between words and words() of the parts, joined, are those of the whole."""
    return _PLAIN.fullmatch(text) is not None


def words(text: str) -> list[str]:
    """The words of a plain text."""
    return _FAST.findall(text.lower())


def library_words(text: str, path: str) -> list[str]:
    """The words of any text, split by the library, whose Unicode tables may be newer than Python's."""
    tok = _library(path)
    found = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))
    return [bytes(map(_BYTES.__getitem__, w)).decode() for w, _ in found]


class Specials:
    """Cuts texts at the special strings of a tokenizer file."""

    def __init__(self, added: list[dict]):
        self.ids = {x["content"]: x["id"] for x in added}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.ids, key=len, reverse=True)) + ")") if added else None

    def pieces(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut and any(x in text for x in self.ids) else [text]


#: Values of rows: one flat array, and the first of each row + total.
Ragged = tuple[np.ndarray, np.ndarray]


def gather(values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> Ragged:
    """The rows asked for, in that order."""
    n = first[rows + 1] - first[rows]
    start = np.concatenate(([0], np.cumsum(n)))
    return values[np.arange(start[-1]) + np.repeat(first[rows] - start[:-1], n)], start


def _numbered(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings, and each string's number."""
    coded = texts.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


#: Bytes of the longest part that a memo keeps: with its length it fills KEYS words of eight bytes.
KEYS = 3
LONGEST = 8 * KEYS - 1
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Memo:
    """Ids of short strings: an open-addressing table from their bytes to rows of a flat array. Full, it starts anew."""

    def __init__(self, bits: int):
        self.bits = bits
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros((1 << self.bits, KEYS), np.uint64)
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.ids, self.first, self.rows = np.empty(1 << 12, np.uint32), np.zeros(1 << 12, np.int64), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys * _SPREAD).sum(1, dtype=np.uint64)
        return ((mixed ^ (mixed >> np.uint64(29))) * _SPREAD[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of keys, -1 where there is none."""
        at, mask = self._home(keys), (1 << self.bits) - 1
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            row = self.row[at]
            same = (self.keys[at] == keys[left]).all(1) & (row >= 0)
            out[left[same]] = row[same]
            go = ~same & (row >= 0)
            left, at = left[go], (at[go] + 1) & mask
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        """Put distinct keys that are not there in, with their ids."""
        n, start = len(keys), int(self.first[self.rows])
        if self.rows + n > 1 << self.bits - 1:
            self._reset()
            start = 0
            if n > 1 << self.bits - 1:
                return
        while len(self.first) <= self.rows + n:
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        while len(self.ids) < start + len(ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[start : start + len(ids)] = ids
        self.first[self.rows + 1 : self.rows + n + 1] = start + first[1:]
        at, mask, left = self._home(keys), (1 << self.bits) - 1, np.arange(n)
        while len(left):
            free = np.flatnonzero(self.row[at] < 0)
            self.row[at[free]] = self.rows + left[free]  # of equal places the last one stays
            won = np.zeros(len(left), bool)
            won[free] = self.row[at[free]] == self.rows + left[free]
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & mask
        self.rows += n


#: What splits parts in a batch of texts; other white space is split within a part.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start and end of each run without blanks, first of each text + total)."""
    raw = "\n".join([*texts, ""]).encode()
    data = np.frombuffer(raw + b" " * 32, np.uint8)
    edge = np.diff(_BLANK[data].astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = store.utf8(pa.array(texts, pa.large_string()))[1]
    return data, starts, ends[: len(starts)], np.searchsorted(starts, sizes + np.arange(len(sizes)))


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of parts of up to LONGEST bytes, and their lengths, as numbers: equal for equal parts only."""
    word = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    out = np.empty((len(starts), KEYS), np.uint64)
    for k in range(KEYS):
        out[:, k] = word[np.minimum(starts + 8 * k, len(word) - 1)] & _MASK[np.clip(sizes - 8 * k, 0, 8)]
    out[:, -1] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


def _ids_of(units: list[list[str]], specials: Specials, encode_words: Callable[[list[str]], Ragged]) -> Ragged:
    """The ids of units, each a list of words and marked special strings."""
    distinct, of_unit = _numbered(pa.array(list(chain.from_iterable(units)), pa.large_string()))
    special = {k: specials.ids[w[1:]] for k, w in enumerate(distinct) if w[0] == "\0" and w[1:] in specials.ids}
    ids, first = encode_words(["" if k in special else w for k, w in enumerate(distinct)] if special else distinct)
    if special:
        ids = np.insert(ids, first[list(special)], list(special.values()))
        more = np.zeros(len(first), np.int64)
        more[np.array(list(special)) + 1] = 1
        first = first + np.cumsum(more)
    ids, first = gather(ids, first, of_unit)
    return ids, first[np.concatenate(([0], np.cumsum([len(u) for u in units]))).astype(np.int64)]


def encode_many(texts: list[str], specials: Specials, path: str, encode_words: Callable[[list[str]], Ragged], memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's start, where they end); `encode_words` gives the ids of distinct words."""
    marked = [bool(specials.cut and any(x in t for x in specials.ids)) for t in texts]
    fast = [k for k, t in enumerate(texts) if not marked[k] and plain(t)]
    data, a, b, at = _parts([texts[k] for k in fast])

    def encode_parts(some: np.ndarray) -> Ragged:
        raw = data.tobytes()
        parts = [raw[x:y].decode() for x, y in zip(a[some].tolist(), b[some].tolist())]
        return _ids_of([[p.lower()] if p.isalpha() else words(p) for p in parts], specials, encode_words)

    short = np.flatnonzero(b - a <= LONGEST)
    keys = _keys(data, a[short], (b - a)[short])
    row = memo.find(keys)
    new = np.flatnonzero(row < 0)
    order = new[np.lexsort(keys[new].T)]
    step = np.concatenate(([True], (keys[order[1:]] != keys[order[:-1]]).any(1)))[: len(order)]
    distinct = order[step]
    long = np.flatnonzero(b - a > LONGEST)
    # rows of: what the memo has, the distinct new parts, the long parts
    ids, first = encode_parts(np.concatenate((short[distinct], long)))
    known = int(memo.first[memo.rows])
    of_part = np.empty(len(a), np.int64)
    of_part[short] = row
    of_part[short[order]] = memo.rows + np.cumsum(step) - 1
    of_part[long] = memo.rows + len(distinct) + np.arange(len(long))
    table = np.concatenate((memo.first[: memo.rows + 1], known + first[1:]))
    flat, first_of = gather(np.concatenate((memo.ids[:known], ids.astype(np.uint32))), table, of_part)
    memo.add(keys[distinct], ids[: first[len(distinct)]], first[: len(distinct) + 1])
    starts, ends = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    starts[fast], ends[fast] = first_of[at[:-1]], first_of[at[1:]]
    # a text that Python can't split as the library does is one unit
    slow = sorted(set(range(len(texts))).difference(fast))
    if slow:
        pieces = [[["\0" + x] if x in specials.ids else words_of(x, path) for x in specials.pieces(texts[k])] for k in slow]
        more, first = _ids_of([list(chain.from_iterable(x)) for x in pieces], specials, encode_words)
        starts[slow], ends[slow] = len(flat) + first[:-1], len(flat) + first[1:]
        flat = np.concatenate((flat, more.astype(np.uint32)))
    return flat, starts, ends


def words_of(text: str, path: str) -> list[str]:
    """The words of any text without special strings."""
    return words(text) if plain(text) else library_words(text, path)
