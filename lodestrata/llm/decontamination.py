"""Benchmark decontamination: passages within a word edit distance of a benchmark item.

Texts and items are sequences of word hashes (lower case, letters and digits).
A CGK random walk embeds the sequence that starts at a word: it copies the
current word at each step and moves on by a random bit of (step, word), so that
few edits make few differences between two embeddings. Repeated bit sampling
(LSH): the key of a window under one of REPEATS walks is the word it starts at
and the embedding at SAMPLED random steps of the first three fifths of the item's
size (`_span`), one of them the third. An item is put in under the keys of its windows at several starts
(`_anchors`: a quarter of its words, 16 at least, those that fewest items have),
a text under the keys of its windows at
every word that some item starts a window with. Where keys meet, the passage is
proposed, and a semi-global edit distance decides. Items of one or two words must
occur as they are and are looked up as such.

Recall: an occurrence within the allowed edits keeps most of its starts, and each
start has REPEATS tries, so it is missed only if all their sampled steps are
disturbed. For the most edits allowed, tests require 0.99 at every size from 3 to
300 words; without edits nothing is missed. The allowed edits are 20 % of an
item's words.

Items are held by each worker, by broadcast; a benchmark beyond BLOCK_MB is taken
in blocks of that size, each against all texts. Defined results: null and empty
texts, and items without words, match nothing; equal items each match; repeated
rows each give their own; a key may be null. One row a document row and item: the
nearest passage, the first of equally near ones. Texts are taken whole, whatever
their length. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import store, words

SIMILARITY = 0.8
REPEATS, SAMPLED, EARLY, LONG = 8, 4, 3, 64
#: Text of items that a worker holds at a time.
BLOCK_MB = 8
CHUNK = 1 << 19

_SEEDS = np.random.default_rng(71).integers(0, 1 << 63, REPEATS, dtype=np.uint64)
_ODD = np.random.default_rng(72).integers(0, 1 << 62, SAMPLED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0xD1342543DE82EF95


def normal_words(column: pa.Array):
    """Word hashes of a text column: (first row, end row, hashes, first word of each row + total), by chunks."""
    data, offsets = store.utf8(pc.utf8_lower(column.fill_null("")))
    for a, b in store.chunks(offsets, CHUNK):
        own = offsets[a : b + 1]
        h, first, _, _ = words.word_hashes(data[own[0] : own[-1]], own - own[0], words.NOT_ALNUM)
        yield a, b, h, first


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return int((1 - SIMILARITY) * n + 1e-9)


def _span(n: int) -> int:
    """Steps that keys of an item of n > 2 words are sampled from: three fifths of n, rounded down to one of few values a doubling.

    From LONG on they grow no more: after so many steps two walks rarely agree
    under the most edits, and a longer item has the more starts.
    """
    most, span = max(3, 3 * min(n, LONG) // 5), 3
    while (after := max(span + 1, span * 6 // 5)) <= most:
        span = after
    return span


def _sampled(span: int, repeat: int) -> list[int]:
    """The ascending steps, behind the first, of a key in one repetition; EARLY is among them where the span reaches it."""
    fixed = [EARLY] if span > EARLY else []
    rest = [j for j in range(1, span) if j not in fixed]
    rng = np.random.default_rng([span, repeat])
    return sorted([*fixed, *rng.choice(rest, min(SAMPLED - len(fixed), len(rest)), replace=False).tolist()])


def embed(h: np.ndarray, end: np.ndarray, at: np.ndarray, repeat: int, steps: list[int], keep=None):
    """(windows, {step: embedding at it}) of the CGK walk from `at` up to `end`; 0 behind the end.

    `keep` is asked at step EARLY which windows go on; the others are left out from there.
    """
    padded = np.concatenate((h, np.zeros(steps[-1] + 2, np.uint64)))
    own, now, out = np.arange(len(at)), at, {}
    for j in range(steps[-1] + 1):
        if j % 64 == 0:  # each word's bits for the next 64 steps
            bits = words.mix(padded ^ np.uint64((int(_SEEDS[repeat]) + _STEP * (j // 64)) % (1 << 64)))
        if j in steps:
            out[j] = np.where(now < end[own], padded[now], np.uint64(0))
        if j == EARLY and keep is not None:
            some = keep(own, out)
            own, now, out = own[some], now[some], {k: v[some] for k, v in out.items()}
        now = now + (bits[now] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
    return own, out


def _key(start: np.ndarray, found: dict, span: int, repeat: int) -> np.ndarray:
    key = start + np.uint64(span * REPEATS + repeat + 1)
    for k, j in enumerate(_sampled(span, repeat)):
        key = key + found[j] * _ODD[k]
    return words.mix(key)


def _early(start: np.ndarray, found: dict, repeat: int) -> np.ndarray:
    """What keys of all spans beyond EARLY depend on."""
    return words.mix(start * _ODD[0] + found[EARLY] * _ODD[1] + np.uint64(repeat))


def _steps(spans: list[int], repeat: int) -> list[int]:
    return sorted({j for x in spans for j in _sampled(x, repeat)})


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the text's best passage for an item, the first of equal ones."""
    slope = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, w in enumerate(item.tolist()):
        step = np.minimum(row[1:] + 1, row[:-1] + (text != np.uint64(w)))
        row = np.minimum.accumulate(np.concatenate(([k + 1], step)) - slope) + slope
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Items as word hashes, and the keys of their windows."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids, self.items = ids, items
        self.sizes = np.array([len(x) for x in items], np.int64)
        self.edits = np.array([allowed(n) for n in self.sizes.tolist()], np.int64)
        self.flat = np.concatenate(items) if items else np.zeros(0, np.uint64)
        first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.span = np.array([_span(n) for n in self.sizes.tolist()], np.int64)
        self.spans = sorted(set(self.span[self.sizes > 2].tolist()))
        owner, place = self._anchors(first)
        at, end = first[owner] + place, first[owner + 1]
        keys, entries, early = [], [], []
        for repeat in range(REPEATS if self.spans else 0):
            _, found = embed(self.flat, end, at, repeat, _steps(self.spans, repeat))
            for span in self.spans:
                own = np.flatnonzero(self.span[owner] == span)
                keys.append(_key(self.flat[at], found, span, repeat)[own])
                entries.append(own)
                if span > EARLY:
                    early.append(_early(self.flat[at], found, repeat)[own])
        self.early = _bits(np.concatenate(early)) if early else None
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        entry = np.concatenate(entries)[order] if entries else np.zeros(0, np.int64)
        self.keys, self.owner, self.place = every[order], owner[entry], place[entry]
        self.starts = np.unique(self.flat[at])
        self.seen, self.known = _bits(self.starts), _bits(self.keys)
        self.short = [(k, x) for k, x in enumerate(items) if 0 < len(x) < 3]

    def _anchors(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, word of it) of the starts of windows that items are put in under."""
        owners = np.repeat(np.arange(len(self.items)), self.sizes)
        place = np.arange(len(self.flat)) - first[owners]
        # in how many items a word is: the fewer, the better a start it makes
        pairs = np.unique(np.column_stack((self.flat, owners.astype(np.uint64))), axis=0) if len(owners) else np.zeros((0, 2), np.uint64)
        word, count = np.unique(pairs[:, 0], return_counts=True)
        common = count[np.searchsorted(word, self.flat)] if len(owners) else owners
        ok = np.flatnonzero((place <= (self.sizes - self.span)[owners]) & (self.sizes[owners] > 2)) if len(owners) else owners
        ok = ok[np.lexsort((words.mix(self.flat[ok]), common[ok], owners[ok]))]
        start = np.searchsorted(owners[ok], np.arange(len(self.items)))
        rank = np.arange(len(ok)) - start[owners[ok]]
        ok = ok[rank < np.maximum(16, self.sizes // 4)[owners[ok]]]
        return owners[ok], place[ok]

    def proposed(self, h: np.ndarray, first: np.ndarray):
        """(row, item, word of the text where the item would start) wherever keys meet; sorted, distinct."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(self.seen(h))
        if len(self.starts):
            at = at[self.starts[np.minimum(np.searchsorted(self.starts, h[at]), len(self.starts) - 1)] == h[at]]
        parts = []
        end, short = first[row[at] + 1], [x for x in self.spans if x <= EARLY]
        for repeat in range(REPEATS if len(at) else 0):
            done = []

            def keep(own, found):
                done.extend((own, _key(h[at], found, x, repeat)) for x in short)
                return self.early(_early(h[at], found, repeat))

            own, found = embed(h, end, at, repeat, _steps(self.spans, repeat), keep if self.early is not None else None)
            done += [(own, _key(h[at[own]], found, x, repeat)) for x in self.spans if self.early is None or x > EARLY]
            for own, key in done:
                some = np.flatnonzero(self.known(key))
                lo, hi = np.searchsorted(self.keys, key[some]), np.searchsorted(self.keys, key[some], "right")
                n = hi - lo
                entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                where = np.repeat(at[own[some]], n)
                parts.append((row[where], self.owner[entry], where - self.place[entry]))
        left = first[row + 1] - np.arange(len(h))
        for k, item in self.short:  # one or two words: as they are
            same = (h == item[0]) & (left >= len(item))
            if len(item) == 2:
                same[:-1] &= h[1:] == item[1]
            where = np.flatnonzero(same)
            parts.append((row[where], np.full(len(where), k), where))
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        row, item, start = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
        return row[new], item[new], start[new]


class _bits:
    """Which numbers can be among some values, by their highest bits: a table of some 32 places a value."""

    def __init__(self, values: np.ndarray):
        self.shift = np.uint64(64 - min(26, max(12, (32 * len(values)).bit_length())))
        self.there = np.zeros(1 << 64 - int(self.shift), bool)
        self.there[(values >> self.shift).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return self.there[(values >> self.shift).astype(np.int64)]


def find(index: Index, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, start word, end word) of each row and item with a passage near enough."""
    row, item, start = index.proposed(h, first)
    found = []
    k = 0
    while k < len(row):
        j = k
        while j < len(row) and row[j] == row[k] and item[j] == item[k]:
            j += 1
        own, d = index.items[item[k]], int(index.edits[item[k]])
        lo, hi, best = int(first[row[k]]), int(first[row[k] + 1]), None
        i = k
        while i < j:  # windows that overlap are verified as one stretch
            a = max(lo, int(start[i]) - d)
            b = int(start[i]) + len(own) + d
            while i + 1 < j and int(start[i + 1]) - d <= b:
                i += 1
                b = int(start[i]) + len(own) + d
            b = min(b, hi)
            i += 1
            # what the stretch lacks of the item's words are edits already
            there = set(h[a:b].tolist())
            if sum(w in there for w in own.tolist()) < len(own) - d:
                continue
            distance, end = nearest(own, h[a:b])
            if distance <= d and (best is None or distance < best[0]):
                back, length = nearest(own[::-1], h[a : a + end][::-1])
                best = (distance, a + end - length - lo, a + end - lo)
        if best:
            found.append((int(row[k]), int(item[k]), *best))
        k = j
    return found


def _blocks(benchmark: DataFrame, item_key: str, item_text: str):
    """Broadcast indexes of BLOCK_MB of items or so at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // int(BLOCK_MB * 1e6)))
    # equal items are told apart by their place, so no hot one makes a large block
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t", F.monotonically_increasing_id()), F.lit(blocks)))
    if blocks > 1:
        items = store.kept(items, "benchmark-items")
    for k in range(blocks):
        rows = items.where(F.col("b") == k).orderBy("i", "t").collect()
        hashes = []
        for _, _, h, first in normal_words(pa.array([r["t"] for r in rows], pa.string())):
            hashes += [h[first[j] : first[j + 1]] for j in range(len(first) - 1)]
        yield spark.sparkContext.broadcast(([r["i"] for r in rows], hashes))


_held: dict = {}


def _index(items) -> Index:
    """A broadcast block's index, made once a worker."""
    value = items.value
    if _held.get("value") is not value:
        _held.update(value=value, index=Index(*value))
    return _held["index"]


def _against(docs: DataFrame, items) -> DataFrame:
    """(doc_id, item_id, item_words, distance, similarity, start_word, end_word) of every leak of these items."""

    def run(batches):
        index = _index(items)
        for batch in batches:
            for a, b, h, first in normal_words(batch.column(1)):
                rows = find(index, h, first) if len(h) and len(index.flat) else []
                keys = batch.column(0).slice(a, b - a).take(pa.array([r[0] for r in rows], pa.int64()))
                n = [len(index.items[r[1]]) for r in rows]
                columns = [keys, pa.array([index.ids[r[1]] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                columns += [pa.array([1 - r[2] / k for r, k in zip(rows, n)], pa.float64()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (3, 4))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "item_words", "distance", "similarity", "start_word", "end_word"])

    return docs.mapInArrow(store.released(run), "doc_id long, item_id long, item_words long, distance long, similarity double, start_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, distance, similarity, start_word, end_word) of every leak, without a shuffle."""
    own, out = docs.select(F.col(key).cast("long").alias("doc_id"), text), None
    for items in _blocks(benchmark, item_key, item_text):
        found = _against(own, items)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without a leak of any item, with all their columns, without a shuffle."""
    own, at = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), docs.columns.index(text)

    def cleaner(items):
        def run(batches):
            index = _index(items)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, h, first in normal_words(batch.column(0).field(at)):
                    if len(h) and len(index.flat):
                        keep[[a + r[0] for r in find(index, h, first)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for items in _blocks(benchmark, item_key, item_text):
        own = own.mapInArrow(store.released(cleaner(items)), own.schema)
    return own.select("row.*")
