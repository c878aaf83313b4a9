"""Toxicity scores: a learned lexicon, found misspelled as well, with the words around a hit weighed in.

The lexicon (whole words, and stems of five to eight letters) comes from labelled
rows: a term stays if its smoothed log-odds and its likelihood ratio statistic
pass one limit each, the same at every size of the table, copies of a text counting
as one (by shared minimum hashes of word triples). Its trie is intersected
with Levenshtein automata: a state is a set of (trie node, edits so far), states
that words really reach are made once, and all words of a batch of texts walk
through the table of states together, a letter a step, in numpy. Terms are found
misspelled only if the evidence for them is strong (`strong_terms`): with one
edit from three letters on (stems from seven on), with two from ten on. A hit one
edit from a term of three or four letters is spared if clean labelled rows have
it as a word of their own; else it counts as the word itself with three quarters
of its weight. Hits
inside quotation marks, more so beside a verb of speech, weigh less; hits beside
a second person weigh more. A logistic regression on the hits' sums gives the
score; it is fitted on sums by lexicons of the other half of the sample, so no
row is weighed by terms that it taught.

Only a bounded, documented sample is fitted on (`Limits`); every row is scored,
over its whole text, in batches of some MB (one text at least). Defined results:
a null or empty text has the score of a text without hits; without labelled rows
of both kinds every score is the share of toxic ones (0 without any). Where no
row of the sample has a misspelling, a misspelled hit weighs as the word itself.
Of labels that repeat for a key the largest counts. Repeated and tied rows each
get a row; a null key is not held out; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import store


@dataclass(frozen=True)
class Limits:
    """Bounds of what is fitted on (labelled rows of each kind, those of the smallest key hashes), and of a term's evidence."""

    rows: int = 3000
    odds: float = 1.5  # least log-odds
    ratio: float = 12.0  # least likelihood ratio statistic (0.0005 of a chi-square of one degree)


# Verbs of speech and second persons in the four languages of the corpus.
_SPEECH = "said says wrote quote quoted called reported word term dit écrit appelé mot sagte schrieb wort dijo escribió palabra".split()
_PERSONS = "you your you're u tu te toi vous votre du dich dir ihr sie euch usted tú ti vosotros".split()
_QUOTES = "\"“”«»"
_JOINERS = "*@$'’-"
#: Words on each side of a hit that are looked at.
WINDOW = 8
FEATURES = 7
#: Bytes of texts that are taken together, and states that an automaton holds before it starts anew.
CHUNK, STATES = 1 << 18, 20_000

#: Hash functions that tell copies in the sample.
KEYS = 8
_A = np.random.default_rng(31).integers(0, 1 << 31, KEYS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(32).integers(0, 1 << 32, KEYS, dtype=np.uint32)

_GAP, _LETTER, _QUOTE, _JOINER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: letter or digit, quotation mark, a mark that joins words, or none of these."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LN"]] = _LETTER
    for marks, kind in ((_QUOTES, _QUOTE), (_JOINERS, _JOINER)):
        out[[ord(c) for c in marks]] = kind
    return out


@dataclass
class Said:
    """The words of a batch of texts, a quotation mark being a word: code points, places of words, rows."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    quotes: np.ndarray
    first: np.ndarray  # first word of each text + total

    def word(self, k: int) -> str:
        return self.points[self.starts[k] : self.ends[k]].tobytes().decode("utf-32-le")


def said(texts: list[str]) -> Said:
    """Runs of letters and digits, those that only joining marks part being one word."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    letter = kind == _LETTER
    edge = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    joiners = np.concatenate(([0], np.cumsum(kind == _JOINER)))
    joined = joiners[starts[1:]] - joiners[ends[:-1]] == starts[1:] - ends[:-1]
    starts, ends = starts[np.concatenate(([True], ~joined))[: len(starts)]], ends[np.concatenate((~joined, [True]))[: len(ends)]]
    marks = np.flatnonzero(kind == _QUOTE)
    order = np.argsort(np.concatenate((starts, marks)), kind="stable")
    quotes = (np.arange(len(order)) >= len(starts))[order]
    starts, ends = np.concatenate((starts, marks))[order], np.concatenate((ends, marks + 1))[order]
    rows = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low]))).astype(np.int64)
    return Said(points, starts, ends, quotes, np.searchsorted(starts, rows))


def terms_of(text: str) -> set[str]:
    """The distinct words of a text and their stems ('abcde*')."""
    found, out = said([text]), set()
    for w in {found.word(k) for k in np.flatnonzero(~found.quotes).tolist()}:
        out.add(w)
        out.update(w[:n] + "*" for n in range(5, min(9, len(w))))
    return out


class Automaton:
    """Levenshtein automata of a lexicon's terms over their common trie; stems take any ending."""

    def __init__(self, lexicon: dict[str, float], strong: frozenset[str] | None = None, spared: frozenset[str] = frozenset()):
        if strong is None:
            strong = frozenset(t for t in lexicon if len(t) >= 5)
        self.spared = spared  # words that are no misspellings of strong ones of three and four letters
        letters = sorted({c for t in lexicon for c in t.rstrip("*")})
        self.symbol = np.zeros(0x110000, np.int16)  # 0: in no term
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: k for k, c in enumerate(letters, 1)}
        self.width = len(letters) + 1
        self.child: list[dict[int, int]] = [{}]
        self.weight: list[float] = [0.0]
        self.stem: list[bool] = [False]
        self.room: list[int] = [0]  # edits allowed to any term below
        self.allowed: list[int] = [-1]
        self.short: set[int] = set()
        for term, weight in lexicon.items():
            body, stem = term.rstrip("*"), term.endswith("*")
            allowed = 0 if term not in strong or len(body) < 3 or (stem and len(body) < 7) else 1 if len(body) < 10 else 2
            node = 0
            self.room[0] = max(self.room[0], allowed)
            for c in map(number.__getitem__, body):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.weight.append(0.0)
                    self.stem.append(False)
                    self.room.append(0)
                    self.allowed.append(-1)
                node = self.child[node][c]
                self.room[node] = max(self.room[node], allowed)
            self.weight[node] = max(self.weight[node], weight)
            self.stem[node] |= stem
            if len(body) < 5 and allowed:
                self.short.add(node)
            self.allowed[node] = max(self.allowed[node], allowed)
        self._reset()

    def _reset(self) -> None:
        self.states: list[bytes] = []  # ascending 4 * node + edits, as unsigned 32-bit integers
        self.known: dict[bytes, int] = {}
        self.accepts = np.zeros((256, 3))
        self.table = np.full((256, self.width), -1, np.int32)
        self.dead = self._state({})
        self.table[self.dead] = self.dead
        self.start = self._state(self._close([(0, 0)]))

    def _close(self, pairs: list[tuple[int, int]]) -> dict[int, int]:
        """Least edits by node, with letters of terms left out of the word."""
        best: dict[int, int] = {}
        while pairs:
            node, e = pairs.pop()
            if best.get(node, 9) > e:
                best[node] = e
                if e < self.room[node]:
                    pairs += [(below, e + 1) for below in self.child[node].values() if e < self.room[below]]
        return best

    def _state(self, best: dict[int, int]) -> int:
        pairs = array("I", sorted([4 * node + e for node, e in best.items()])).tobytes()
        k = self.known.get(pairs)
        if k is None:
            k = self.known[pairs] = len(self.states)
            self.states.append(pairs)
            if k == len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
                self.accepts = np.concatenate((self.accepts, np.zeros_like(self.accepts)))
            exact = fuzzy = near = 0.0
            for node, e in best.items():
                if e <= self.allowed[node]:
                    if e == 0:
                        exact = max(exact, self.weight[node])
                    elif node in self.short:
                        near = max(near, self.weight[node] * 0.75**e)
                    else:
                        fuzzy = max(fuzzy, self.weight[node] * 0.75**e)
            self.accepts[k] = (exact, 0.0, 0.0) if exact else (0.0, fuzzy, near)
        return k

    def _step(self, state: int, c: int) -> int:
        pairs = []
        for x in memoryview(self.states[state]).cast("I"):
            node, e = x >> 2, x & 3
            child = self.child[node]
            if c in child:
                pairs.append((child[c], e))
            if e < self.room[node]:
                pairs.append((node, e + 1))  # a letter too many
                pairs += [(below, e + 1) for below in child.values() if e < self.room[below]]
            if self.stem[node] and e <= self.allowed[node]:
                pairs.append((node, e))  # a stem takes any ending
        return self._state(self._close(pairs))

    def walk(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words x 3) weights of an exact hit, of a misspelled one, of a misspelled strong word of three or four letters; 0 for none."""
        if len(self.states) > STATES:
            self._reset()
        symbols = self.symbol[points]
        out = np.full(len(starts), self.dead)
        own = np.flatnonzero(ends > starts)
        at, state = starts[own], np.full(len(own), self.start)
        while len(own):
            c = symbols[at]
            after = self.table[state, c]
            new = after < 0
            if new.any():
                for code in np.unique(state[new] * self.width + c[new]).tolist():
                    k = self._step(*divmod(code, self.width))
                    self.table[code // self.width, code % self.width] = k
                after = self.table[state, c]
            at = at + 1
            ended = at == ends[own]
            out[own[ended]] = after[ended]
            go = ~ended & (after != self.dead)
            own, at, state = own[go], at[go], after[go]
        found = self.accepts[out]
        near = np.flatnonzero(found[:, 2])
        for k in near.tolist():
            if ends[k] - starts[k] < 3 or points[starts[k] : ends[k]].tobytes().decode("utf-32-le") in self.spared:
                found[k, 2] = 0.0
        return found

    def match(self, word: str) -> tuple[float, float, float]:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        return tuple(self.walk(points, np.array([0]), np.array([len(points)]))[0].tolist())

    def features(self, texts: list[str]) -> np.ndarray:
        """(texts x FEATURES) sums and largest of the hits' weights, exact and misspelled, abuse and quotation apart."""
        own = said(texts)
        found = self.walk(own.points, own.starts, own.ends)
        found[own.quotes] = 0.0
        hits = np.flatnonzero(found.any(1))
        row = np.searchsorted(own.first, hits, "right") - 1
        low, high = own.first[row], own.first[row + 1]
        quotes = np.concatenate(([0], np.cumsum(own.quotes)))
        quoted = (quotes[hits] > quotes[np.maximum(low, hits - WINDOW)]) & (quotes[np.minimum(high, hits + 1 + WINDOW)] > quotes[hits + 1])
        speech = _beside(_speech(), own, hits, low, high, WINDOW)
        person = _beside(_persons(), own, hits, low, high, 3)
        factor = np.where(quoted, np.where(speech, 0.3, 0.6), np.where(person, 1.2, 1.0))
        sums, most = np.zeros((3, len(texts))), np.zeros((3, len(texts)))
        for j, x in enumerate((np.maximum(found[hits, 0], found[hits, 2]) * factor, found[hits, 1] * factor)):
            for k, some in ((j, ~quoted), (2, quoted)):
                sums[k] += np.bincount(row[some], x[some], len(texts))
                np.maximum.at(most[k], row[some], x[some])
        return np.column_stack((*np.log1p(sums), *most, (sums[0] + sums[1]) / (20 + np.diff(own.first))))


def _beside(words: Automaton, own: Said, hits: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int) -> np.ndarray:
    """Which hits have one of the words within `reach` words in their text."""
    left, right = np.maximum(low, hits - reach), np.minimum(high, hits + 1 + reach)
    near = np.zeros(len(own.starts) + 1, np.int64)
    np.add.at(near, left, 1)
    np.add.at(near, right, -1)
    looked = np.flatnonzero(np.cumsum(near)[:-1])
    there = np.zeros(len(own.starts), bool)
    there[looked] = words.walk(own.points, own.starts[looked], own.ends[looked])[:, 0] > 0
    total = np.concatenate(([0], np.cumsum(there)))
    return total[right] - total[left] - there[hits] > 0


@lru_cache(maxsize=1)
def _speech() -> Automaton:
    return Automaton(dict.fromkeys(_SPEECH, 1.0))


@lru_cache(maxsize=1)
def _persons() -> Automaton:
    return Automaton(dict.fromkeys(_PERSONS, 1.0))


def signature(text: str) -> np.ndarray:
    """For each of KEYS hash functions, the least hash of the text's word triples: texts share a key as often as their sets of triples are alike."""
    found = said([text])
    codes = np.array([zlib.crc32(found.points[a:b].tobytes()) for a, b in zip(found.starts.tolist(), found.ends.tolist())] or [0], np.uint32)
    if len(codes) > 2:
        codes = (codes[:-2] * _A[0] + codes[1:-1]) * _A[1] + codes[2:]
    return (codes[:, None] * _A + _B).min(0)


def weights_of(signatures: np.ndarray) -> np.ndarray:
    """Each text's weight as evidence: the mean, over the hash functions, of one over how many texts share its key. A group of copies weighs as one text."""
    out = np.zeros(len(signatures))
    for column in signatures.T:
        _, where, n = np.unique(column, return_inverse=True, return_counts=True)
        out += 1 / n[where]
    return out / signatures.shape[1]


def odds(pos: float, neg: float, toxic: float, clean: float) -> float:
    """Smoothed log-odds of a term that `pos` toxic and `neg` clean rows have."""
    return float(np.log((pos + 0.2) / (toxic + 1)) - np.log((neg + 0.2) / (clean + 1)))


def ratio(pos: float, neg: float, toxic: float, clean: float) -> float:
    """Likelihood ratio statistic of a term against the shares of all rows."""
    part = lambda n, share: n * np.log(n / ((pos + neg) * share)) if n else 0.0
    return float(2 * (part(pos, toxic / (toxic + clean)) + part(neg, clean / (toxic + clean))))


def _told(pos: Column, neg: Column, toxic: float, clean: float, limits: Limits) -> Column:
    """Whether a term's evidence passes the limits."""
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((pos + neg) * share))).otherwise(0.0)
    statistic = 2 * (part(pos, toxic / (toxic + clean)) + part(neg, clean / (toxic + clean)))
    return (F.log((pos + 0.2) / (toxic + 1)) - F.log((neg + 0.2) / (clean + 1)) > limits.odds) & (statistic > limits.ratio)


def lexicon(counts: list[tuple[str, float, float]], toxic: float, clean: float, limits: Limits = Limits()) -> dict[str, float]:
    """Terms of enough evidence with their log-odds. All words stay; a stem stays if it tells more texts than any one word of it, and no shorter stem tells as much."""
    told = [(t, pos, odds(pos, neg, toxic, clean)) for t, pos, neg in counts if odds(pos, neg, toxic, clean) > limits.odds and ratio(pos, neg, toxic, clean) > limits.ratio]
    best: dict[str, float] = {}
    for t, pos, _ in told:
        if not t.endswith("*"):
            for n in range(5, min(9, len(t) + 1)):
                best[t[:n]] = max(best.get(t[:n], 0), pos)
    stems = {t: w for t, pos, w in told if t.endswith("*") and pos >= 1.3 * best.get(t[:-1], 0)}
    stems = {t: w for t, w in stems.items() if not any(stems.get(t[:n] + "*", 0) >= w - 0.01 for n in range(5, len(t) - 1))}
    return {t: w for t, _, w in told if not t.endswith("*")} | stems


def strong_terms(counts: list[tuple[str, float, float]], toxic: float, clean: float) -> frozenset[str]:
    """Terms whose log-odds pass the lexicon's limit even two standard errors lower."""
    error = lambda pos, neg: 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return frozenset(t for t, pos, neg in counts if odds(pos, neg, toxic, clean) - error(pos, neg) > Limits.odds)


@dataclass
class Model:
    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    strong: frozenset[str] = frozenset()
    spared: frozenset[str] = frozenset()

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


@lru_cache(maxsize=1)
def _automaton(terms: tuple, strong: frozenset, spared: frozenset) -> Automaton:
    """One automaton a worker."""
    return Automaton(dict(terms), strong, spared)


def regress(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 25):
    """Logistic regression by damped Newton steps on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    scale[x.std(0) < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + ridge * w
        bend = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return mean, scale, w[:-1], float(w[-1])


def hits_count(x: np.ndarray, y: np.ndarray):
    """The regression with no hit outside quotation speaking against toxicity: columns that would are left out, the worst first."""
    used = list(range(x.shape[1]))
    while True:
        mean, scale, some, bias = regress(x[:, used], y)
        bad = [(w, k) for w, k in zip(some, used) if w < 0 and k not in (2, 5)]
        if not bad:
            weights, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.ones(x.shape[1])
            weights[used], m[used], s[used] = some, mean, scale
            return m, s, weights, bias
        used.remove(min(bad)[1])


def remainder(key: str):
    """The held-out fold is 0 of crc32(key as text) mod 5."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", limits: Limits = Limits()) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & (remainder(key) != 0)).groupBy(key).agg(F.max("toxic").cast("int").alias("_y"))
    kinds = [marked.where(F.col("_y") == k).orderBy(F.xxhash64(key), key).limit(limits.rows) for k in (0, 1)]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]))  # 2 * limits.rows rows at most
    half = F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)).cast("int").alias("_half")
    sample = store.kept(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(chosen, key).select("_t", "_y", half, F.monotonically_increasing_id().alias("_id")), "toxicity-sample")

    def sign(batches):
        for batch in batches:
            keys = [signature(t).astype(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"keys": pa.array(keys, pa.list_(pa.int64()))} | {c: batch.column(c) for c in ("_id", "_y", "_half")})

    # bounded: KEYS numbers of each of 2 * limits.rows rows (of repeated keys more)
    signed = sample.mapInArrow(sign, "keys array<long>, _id long, _y int, _half int").collect()
    weight = dict(zip([r["_id"] for r in signed], weights_of(np.array([r["keys"] for r in signed])).tolist())) if signed else {}
    totals = np.zeros((2, 2))  # half, kind
    for r in signed:
        totals[r["_half"], r["_y"]] += weight[r["_id"]]
    clean, toxic = totals.sum(0).tolist()
    none = np.zeros(FEATURES)
    if not clean or not toxic:
        return Model({}, none, none + 1, none, 30.0 if toxic else -30.0)

    names = ["p0", "n0", "p1", "n1"]

    def count(batches):
        found = [defaultdict(float) for _ in names]
        for batch in batches:
            for t, y, h, i in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own, w = found[2 * h + 1 - y], weight[i]
                for term in terms_of(t):
                    own[term] += w
        every = list(set().union(*found))
        for k in range(0, len(every), 20_000):
            some = every[k : k + 20_000]
            yield pa.RecordBatch.from_pydict({"term": some} | {c: [n.get(t, 0.0) for t in some] for c, n in zip(names, found)})

    table = sample.mapInArrow(count, "term string, " + ", ".join(f"{c} double" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    table = store.kept(table, "toxicity-terms")
    # what passes is bounded by its evidence: each term takes several rows of the bounded sample
    sides = [("p0", "n0", totals[0]), ("p1", "n1", totals[1])]
    passes = _told(F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1"), toxic, clean, limits)
    for p, n, (c, t) in sides:
        if c and t:
            passes = passes | _told(F.col(p), F.col(n), float(t), float(c), limits)
    counts = [tuple(r) for r in table.where(passes).orderBy("term").collect()]
    whole = [(t, p0 + p1, n0 + n1) for t, p0, n0, p1, n1 in counts]
    terms, strong = lexicon(whole, toxic, clean, limits), strong_terms(whole, toxic, clean)
    spared: frozenset[str] = frozenset()
    if few := sorted(t for t in strong if 3 <= len(t) < 5):
        short = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in few], "_s string"))
        own = table.where((F.col("n0") + F.col("n1") > 0) & ~F.endswith("term", F.lit("*")) & (F.length("term") <= 5)).join(short, F.levenshtein("term", "_s") == 1)
        spared = frozenset(x[0] for x in own.select("term").distinct().collect())  # words of the sample
    crossed = [terms, terms]
    for h, k in ((0, 3), (1, 1)):  # by the other half's counts, where it has both kinds
        c, t = totals[1 - h].tolist()
        if c and t:
            crossed[h] = lexicon([(r[0], r[k], r[k + 1]) for r in counts], t, c, limits)

    def measure(batches):
        both = [Automaton(x, strong, spared) for x in crossed]
        for batch in batches:
            texts, halves = batch.column(0).to_pylist(), np.array(batch.column(2))
            x = np.empty((len(texts), FEATURES))
            for h in (0, 1):
                own = np.flatnonzero(halves == h)
                for k in range(0, len(own), 200):
                    x[own[k : k + 200]] = both[h].features([texts[j] for j in own[k : k + 200]])
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(x), pa.list_(pa.float64())), "y": batch.column(1)})

    seen = sample.mapInArrow(measure, "x array<double>, y int").collect()  # 2 * limits.rows rows at most
    x = np.array([r["x"] for r in seen])
    mean, scale, weights, bias = hits_count(x, np.array([r["y"] for r in seen], float))
    for exact, fuzzy in ((0, 1), (3, 4)):
        if not x[:, fuzzy].any():  # no misspelling in the sample tells for or against: it counts as the word itself
            mean[fuzzy], scale[fuzzy], weights[fuzzy] = 0.0, scale[exact], weights[exact]
    return Model(terms, mean, scale, weights, bias, strong, spared)


def judged(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """(row struct of the kept columns (None: all), held_out, score, predicted) of every row, without a shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    held = (F.coalesce(remainder(key), F.lit(1)) == 0).alias("held_out")
    within = docs.columns.index(text) if keep is None else None  # a row that holds the text is not given another
    own = docs.select(row, held, *([] if keep is None else [F.col(text).alias("text")]))

    def run(batches):
        auto = _automaton(tuple(model.lexicon.items()), model.strong, model.spared)
        for batch in batches:
            texts = batch.column(2) if within is None else batch.column(0).field(within)
            for a, b in store.chunks(store.utf8(texts)[1], CHUNK):
                part = batch.slice(a, b - a)
                score = model.scores(auto.features([t or "" for t in texts.slice(a, b - a).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["row", "held_out", "score", "predicted"])

    return own.mapInArrow(store.released(run), f"row {own.schema['row'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    return judged(docs, model, text, key, (key,)).select(F.col(f"row.`{key}`").alias(key), "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return judged(docs, model, text, key).where(F.col("predicted") == 0).select("row.*")
