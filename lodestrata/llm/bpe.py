"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that no vocabulary token holds can never be merged
over, so a word is cut there for certain. The fragments between such cuts are
encoded independently of each other and the ids concatenated. The distinct
words of a batch that a worker's memo lacks are encoded together: in each round every fragment makes its
merge of lowest rank (the leftmost of equal ones), by numpy over all fragments
at once. Long fragments are merged one at a time over a heap, so their cost
stays near-linear. Decoding is a step of its own: it gathers the bytes of each
id's token from a table.

Defined results: a null or empty text has no ids and decodes to ''. Special
strings inside a text become their ids. Texts are taken whole, whatever their
length, in batches of some MB (one text at least). Repeated and tied rows each
keep a row; columns other than the two named ones are ignored; an empty table
gives no rows. Decoding is the tokenizers library's for a file without decoder:
the tokens joined by spaces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm import pretoken, store

#: Bytes of texts that are taken together.
CHUNK = 1 << 18
#: Places in a worker's memo, as a power of two (some 60 bytes each, half of them used).
MEMO = 18
#: Fragments of more bytes are merged over a heap.
LONG = 48

_NONE = np.int64(1 << 30)
_PLACE = (1 << 32) - 1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class ForcedBoundaryBPE:
    """Encoder and decoder of one tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, self.path = file["model"], path
        self.specials = pretoken.Specials(file["added_tokens"])
        self.memo = pretoken.Memo(MEMO)
        self.end: str = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = pretoken.BYTE_LETTERS
        if missing := [x for x in letters if x not in vocab or x + self.end not in vocab]:
            raise ValueError(f"the vocabulary lacks bytes: {missing[:8]}")
        self.inner = np.array([vocab[x] for x in letters])  # ids of a byte inside a word, and at its end
        self.final = np.array([vocab[x + self.end] for x in letters])
        self._tables(vocab)
        self._merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.ids.items()}
        self.known = np.zeros(max(names) + 1, bool)
        self.known[list(names)] = True
        raw = [names[i].encode() + b" " if i in names else b"" for i in range(len(self.known))]
        self.name_bytes, self.name_first = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))

    def _tables(self, vocab: dict[str, int]) -> None:
        """Which neighbouring bytes some token holds: the second inside a word, or ending it."""
        byte = {x: b for b, x in enumerate(pretoken.BYTE_LETTERS)}
        self.inside, self.closing = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        for token in vocab:
            ends = bool(self.end) and token.endswith(self.end)
            body = [byte[c] for c in (token.removesuffix(self.end) if ends else token) if c in byte]
            pairs = list(zip(body, body[1:]))
            if ends and pairs:
                self.closing[pairs.pop()] = True
            for x in pairs:
                self.inside[x] = True

    def _merges(self, merges: list[tuple[int, int, int]]) -> None:
        """An open-addressing table from a pair of ids to the merge's rank."""
        self.made = np.array([m[2] for m in merges], np.int64)
        bits = max(4, (4 * len(merges)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(mask + 1, -1, np.int64), np.full(mask + 1, _NONE)
        for r, (a, b, _) in enumerate(merges):
            key = a << 32 | b
            at = self._home(key)
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & mask
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, r

    def _home(self, key: int) -> int:
        return (key * int(_SPREAD) & (1 << 64) - 1) >> int(self.shift)

    def rank(self, a: int, b: int) -> int | None:
        """The rank of one pair of ids."""
        key = a << 32 | b
        at = self._home(key)
        while (there := self.keys.item(at)) >= 0:
            if there == key:
                return self.ranks.item(at)
            at = (at + 1) & (len(self.keys) - 1)
        return None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}  # each worker has its own

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, memo=pretoken.Memo(MEMO))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _NONE where they never merge."""
        key = a << 32 | b
        at = ((key.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == key, self.ranks[at], _NONE)
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            hit = there == key[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def _lockstep(self, ids: np.ndarray, first: np.ndarray) -> pretoken.Ragged:
        """All merges of all (non-empty) fragments."""
        n = len(first) - 1
        size, fragment = np.diff(first), np.arange(n)
        last = np.zeros(len(ids), bool)
        last[first[1:] - 1] = True
        rank = np.full(len(ids), _NONE)
        inner = np.flatnonzero(~last)
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        sizes, done = np.zeros(n, np.int64), []
        while len(fragment):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat((rank << 32) + np.arange(len(ids)), start)
            live = low < _NONE << 32
            at = low[live] & _PLACE
            ids[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            drop = np.repeat(~live, size)
            sizes[fragment[~live]] = size[~live]
            done.append((fragment[~live], ids[drop]))
            drop[at + 1] = True
            at -= np.cumsum(drop)[at]
            ids, rank, last = ids[~drop], rank[~drop], last[~drop]
            size, fragment = size[live] - 1, fragment[live]
            rank[at] = _NONE
            some = at[~last[at]]
            rank[some] = self._ranks(ids[some], ids[some + 1])
            some = at[at > np.cumsum(size) - size] - 1
            rank[some] = self._ranks(ids[some], ids[some + 1])
        to = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(to[-1], np.int64)
        for own, found in done:
            n = sizes[own]
            out[np.arange(len(found)) + np.repeat(to[own] - np.cumsum(n) + n, n)] = found
        return out, to

    def _heap(self, ids: list[int]) -> list[int]:
        """All merges of one fragment, over a linked list and a heap of (rank, place)."""
        n, get = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a, b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = int(self.made[r]), -1, after[j]
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (r := get(ids[left], ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
            if after[k] < n:
                before[after[k]] = k
        return [x for x in ids if x >= 0]

    def _cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte ids, first of each fragment + total) of the bytes of words."""
        full = first[:-1][np.diff(first) > 0]
        ends = np.zeros(len(data) + 1, bool)
        ends[np.append(full, len(data))] = True
        final = ends[1:]
        begins = ends[:-1].copy()
        closing = np.append(final[1:], False)
        begins[1:] |= ~np.where(closing, self.closing[data, np.append(data[1:], 0)], self.inside[data, np.append(data[1:], 0)])[:-1]
        return np.where(final, self.final[data], self.inner[data]), np.append(np.flatnonzero(begins), len(data))

    def encode_words(self, words: list[str]) -> pretoken.Ragged:
        """The ids of each word (none of an empty one)."""
        data, of_word = store.utf8(pa.array(words, pa.large_string()))
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        ids, first = self._cut(data, of_word)
        long = np.flatnonzero(np.diff(first) > LONG)
        if len(long):
            short = np.diff(first) <= LONG
            some, at = pretoken.gather(ids, first, np.flatnonzero(short))
            merged, to = self._lockstep(some, at)
            rows = [merged[a:b] for a, b in zip(to, to[1:])] if len(at) > 1 else []
            own = iter(rows)
            rows = [next(own) if s else np.array(self._heap(ids[first[k] : first[k + 1]].tolist()), np.int64) for k, s in enumerate(short)]
            merged, to = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        else:
            merged, to = self._lockstep(ids, first)
        return merged, to[np.searchsorted(first, of_word)]

    def fragments_of(self, word: str) -> list[bytes]:
        """The bytes of a word between its forced cuts."""
        data = np.frombuffer(word.encode(), np.uint8)
        _, first = self._cut(data, np.array([0, len(data)]))
        return [data[a:b].tobytes() for a, b in zip(first, first[1:])]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's start, where they end)."""
        return pretoken.encode_many(texts, self.specials, self.path, self.encode_words, self.memo)

    def decode_many(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all, where each decoded text starts, where it ends); ids without a token are left out."""
        ok = self.known[np.minimum(ids, len(self.known) - 1)] & (ids < len(self.known))
        raw, first = pretoken.gather(self.name_bytes, self.name_first, np.where(ok, ids, 0)) if ok.all() else self._some(ids, ok)
        a, b = first[starts], first[ends]
        return raw, a, np.maximum(a, b - 1)

    def _some(self, ids: np.ndarray, ok: np.ndarray) -> pretoken.Ragged:
        raw, first = pretoken.gather(self.name_bytes, self.name_first, ids[ok])
        return raw, first[np.concatenate(([0], np.cumsum(ok)))]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        raw, a, b = self.decode_many(np.array(ids, np.int64), np.array([0]), np.array([len(ids)]))
        return raw[a[0] : b[0]].tobytes().decode()


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


_sent: dict = {}


def _broadcast(context, path: str):
    """The encoder as one broadcast an application, some MB by the tokenizer's size: workers keep what they were sent."""
    key = context.applicationId, path
    if key not in _sent:
        _sent.clear()
        _sent[key] = context.broadcast(encoder(path))
    return _sent[key]


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """(key, kept columns..., n_tokens, ids binary, decoded string) of every row, without a shuffle; with `digests`, their sha256 instead."""
    fields = [f for f in docs.select(key, *keep).schema.fields]
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids binary, decoded string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + made

    held = _broadcast(docs.sparkSession.sparkContext, path)

    def run(batches):
        coder = held.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in store.chunks(store.utf8(texts)[1], CHUNK):
                own = batch.slice(a, b - a)
                ids, starts, ends = coder.encode_many([t or "" for t in texts.slice(a, b - a).to_pylist()])
                raw, lo, hi = coder.decode_many(ids, starts, ends)
                ids, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(raw)
                id_bytes = [ids[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]
                said = [raw[s:e] for s, e in zip(lo.tolist(), hi.tolist())]
                if digests:
                    columns = [pa.array([hashlib.sha256(x).hexdigest() for x in c], pa.string()) for c in (id_bytes, said)]
                else:
                    columns = [pa.array([bytes(x) for x in id_bytes], pa.binary()), pa.array([str(x, "utf-8") for x in said], pa.string())]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(ends - starts), *columns], names=[*own.schema.names[:-1], *(x.split()[0] for x in made.split(", "))])

    return docs.select(key, *keep, text).mapInArrow(store.released(run), schema)
