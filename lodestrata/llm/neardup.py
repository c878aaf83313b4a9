"""Near-duplicates by SetSketch registers.

A text's set of word shingles is sketched in one pass: register i holds, on an
exponential scale of base BASE and truncated to a byte, the smallest of the
set's hashes under function i (so sketches of parts merge by maximum). Texts of
equal sets become one class first. Bands of registers make buckets; in a bucket
members are compared with a hub, not with each other. A pair's similarity is
estimated jointly from both sketches and both set sizes by maximum likelihood,
and what may reach the threshold is verified on the full sets.

What the hubs leave apart goes on, and only pairs of different components are
looked at. Small buckets are paired whole. The members of larger ones are keyed
by their rarest shingles instead, so many that two linked sets must have one of
them in common (prefix filter; any order is exact, counts only make a good one).
What shares a key that many have meets its smallest set, and the rest is paired
whole, but for pairs that a bound rules out before they are made: two members
share what both keep of the hub's set and the differences from it that they have
in common, and bitmaps of the differences bound the latter. So no link between
members of a bucket is lost, no cap is set, and a pair is made once.

Defined results: null and empty texts, and texts without words, have empty sets
and link with nothing. Rows that repeat, and rows with equal keys, each get a
row. Texts of any length are taken whole. Links are found between classes of equal sets, whatever the keys of their
rows, so texts of one key are linked each by itself. A row without key is linked
like others, but names no component: a component of such rows alone has a null
id, and they are kept. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import store, words
from lodestrata.llm.components import connected_components

BANDS, ROWS = 30, 5
BASE, RATE = 1.2, 20.0
#: How far an estimate may fall short of the threshold.
MARGIN = 0.17
#: Ids that are broadcast to pick rows from the documents (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
CHUNK = 1 << 19
#: Columns of a member's differences from its hub: a bitmap of 64 bits each.
BITS = [f"d{k}" for k in range(8)]
#: Pairs of full sets that Python gets at a time.
PAIRS = 256
#: Larger buckets are split by rare shingles, and larger keys meet a hub, before pairs are made.
LARGE = 32
#: Counters by which shingles are ordered, rare ones first.
COUNTERS = 1 << 16

_rng = np.random.default_rng(93)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows x registers) bytes of non-empty sets of 64-bit hashes."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    high = (words.mix(values) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), BANDS * ROWS), np.uint8)
    if not len(first):
        return out
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((low if k % 2 else high) * _A[k] + _B[k], first)
        wait = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
        out[:, k] = np.clip(np.floor(1 - np.log(wait) / math.log(BASE)), 0, 255)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union."""
    return np.maximum(a, b)


def similarity(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches with set sizes n and m."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - more - less
    u = n / (n + m)
    v = 1 - u
    best, value = np.full(len(x), -np.inf), np.zeros(len(x))
    top = np.minimum(u / v, v / u)
    chance = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    for j in np.linspace(0, 1, 51):
        j = top * j
        p, q = chance(u - v * j), chance(v - u * j)
        fit = more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + same * np.log(np.maximum(1 - p - q, 1e-12))
        better = fit > best
        best, value = np.where(better, fit, best), np.where(better, j, value)
    return value


def _sets(column: pa.Array, size: int):
    """Chunks of rows of a text column: (first row, end row, set members, first member of each row + total)."""
    data, offsets = store.utf8(column)
    for a, b in store.chunks(offsets, CHUNK):
        own = offsets[a : b + 1]
        h, first, _, _ = words.word_hashes(data[own[0] : own[-1]], own - own[0])
        yield a, b, *words.sets(*words.shingles(h, first, size))


def _row_hash(text: str, key: str) -> Column:
    """Finds a row again by its key and text: unlike the key alone, neither null nor shared by different texts."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def sketch(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, at, n_shingles, s1, s2, regs): the row's hash, set size, two sums that tell sets apart, and registers (null for empty sets)."""

    def run(batches):
        for batch in batches:
            for a, b, values, first in _sets(batch.column(2), size):
                n = np.diff(first)
                full = np.flatnonzero(n)
                at = first[:-1][full]
                sums = np.zeros((2, b - a), np.uint64)
                regs: list = [None] * (b - a)
                if len(full):
                    sums[0, full] = np.add.reduceat(words.mix(values), at)
                    sums[1, full] = np.add.reduceat(words.mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for k, r in zip(full.tolist(), registers(values, at)):
                        regs[k] = r.tobytes()
                columns = [*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "n_shingles", "s1", "s2", "regs"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), _row_hash(text, key).alias("at"), text).mapInArrow(store.released(run), "doc_id long, at long, n_shingles long, s1 long, s2 long, regs binary")


def _plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the threshold, with an estimate."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(store.utf8(batch.column(k))[0], np.uint8).reshape(-1, BANDS * ROWS) for k in (3, 5))
                est = similarity(x, y, *(batch.column(k).to_numpy().astype(float) for k in (2, 4)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], names=["a", "b", "est"])

    estimated = joined.select("a", "b", "n_a", "regs_a", "n_b", "regs_b").mapInArrow(store.released(run), "a long, b long, est double")
    return estimated.where(F.col("est") >= threshold - MARGIN)


def _members_of(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(id, members): the full sets, as sorted hashes, of every class in `pairs` (a, b)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "at"), "rep")
    ids = store.kept(ids.select("at", F.col("rep").alias("id")), "wanted")
    small = ids.count() <= BROADCAST_IDS

    def collect(batches):
        for batch in batches:
            for a, b, values, first in _sets(batch.column(1), size):
                members = [values[first[k] : first[k + 1]].tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(members, pa.binary())], names=["id", "members"])

    own = docs.select(_row_hash(text, key).alias("at"), F.col(text).alias("_text")).join(F.broadcast(ids) if small else ids, "at")
    sets = store.kept(own.select("id", "_text").mapInArrow(store.released(collect), "id long, members binary").dropDuplicates(["id"]), "full-sets")
    store.drop(ids)
    return sets


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("id").alias(x), F.col("members").alias(f"set_{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    sets = _members_of(docs, pairs, reps, size, text, key)

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with store.small_batches(docs.sparkSession, PAIRS):
        found = store.kept(_with_sets(pairs, sets).mapInArrow(store.released(compare), "a long, b long"), "links")
    store.drop(sets)
    return found


def _differences(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(rep, hub, lacks, has, d0..) of pairs (a member, b hub): how many of the hub's shingles a member lacks, how many others it has, and a bitmap of both."""
    sets = _members_of(docs, pairs, reps, size, text, key)
    names = ["rep", "hub", "lacks", "has", *BITS]

    def split(batches):
        for batch in batches:
            counts, maps = [], np.zeros((batch.num_rows, 64 * len(BITS)), bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                odd = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(odd)) // 2
                counts.append((len(y) - both, len(x) - both))
                maps[k, (odd % np.uint64(maps.shape[1])).astype(np.int64)] = True
            words_ = np.packbits(maps, axis=1).view(">i8").astype(np.int64)
            columns = [batch.column(0), batch.column(1), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)), *(pa.array(words_[:, k]) for k in range(len(BITS)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    found = _with_sets(pairs, sets).mapInArrow(store.released(split), ", ".join(f"{c} long" for c in names))
    with store.small_batches(docs.sparkSession, PAIRS):
        found = store.kept(found, "differences")
    store.drop(sets)
    return found


def _most_shared(n: str, x: str, y: str) -> Column:
    """No pair of members of one hub shares more: what both keep of the hub, and the differences that their bitmaps let them have in common.

    A bit that one has and the other lacks stands for at least one difference of
    the one that the other doesn't have.
    """
    apart = lambda a, b: sum((F.bit_count(F.col(f"{c}{a}").bitwiseAND(F.bitwise_not(F.col(f"{c}{b}")))) for c in BITS[1:]), F.bit_count(F.col(f"{BITS[0]}{a}").bitwiseAND(F.bitwise_not(F.col(f"{BITS[0]}{b}")))))
    total = lambda a: F.col(f"lacks{a}") + F.col(f"has{a}")
    hub = F.col(n) + F.col(f"lacks{x}") - F.col(f"has{x}")
    return hub - F.col(f"lacks{x}") - F.col(f"lacks{y}") + F.least(total(x) - apart(x, y), total(y) - apart(y, x))


def _slots(values: np.ndarray) -> np.ndarray:
    return (words.mix(values) >> np.uint64(32)).astype(np.int64) % COUNTERS


def _rarest(docs: DataFrame, wanted: DataFrame, reps: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    """(rep, n, items): the rarest shingles of every class in `wanted` (a, b), so many that any linked class has one of them."""
    sets = _members_of(docs, wanted, reps, size, text, key)

    def count(batches):
        for batch in batches:
            values, times = np.unique(store.utf8(batch.column(0))[0].copy().view(np.uint64), return_counts=True)
            sums = np.bincount(_slots(values[times > 1]), times[times > 1], COUNTERS).astype(np.int64)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["slot", "times"])

    counted = sets.select("members").mapInArrow(store.released(count), "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(COUNTERS, np.int64)
    times[counted.column("slot").to_numpy()] = counted.column("times").to_numpy()

    def cut(batches):
        for batch in batches:
            items, lengths = [np.zeros(0, np.uint64)], []
            for x in batch.column(1):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                most = len(x) - -(-percent * len(x) // 100) + 1
                items.append(x[np.lexsort((x, times[_slots(x)]))[:most]])
                lengths.append((len(x), len(items[-1])))
            ends = np.cumsum([0, *(k for _, k in lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(items).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in lengths], pa.int64()), lists], names=["rep", "n", "items"])

    with store.small_batches(docs.sparkSession, PAIRS):
        found = store.kept(sets.mapInArrow(store.released(cut), "rep long, n long, items array<long>"), "rarest")
    store.drop(sets)
    return found


def _in_reach(n: Column, pos: Column, other: Column, percent: int) -> Column:
    """Whether the first shingle that a set of n shares with a linked one of `other` can be its rarest but pos."""
    return (n - pos) * (100 + percent) >= percent * (n + other)


def _keyed(rarest: DataFrame, percent: int) -> DataFrame:
    """(band, rep, n, pos) of each shingle that some set in reach shares; pos is its place among the set's rarest."""
    keys = store.kept(rarest.select("rep", "n", F.posexplode("items").alias("pos", "band")).select("band", "rep", "n", "pos"), "keys")
    least = keys.groupBy("band").agg(F.min("n").alias("_least"), F.count("*").alias("_m")).where(F.col("_m") > 1)
    rows = keys.join(least, "band").where(_in_reach(F.col("n"), F.col("pos"), F.col("_least"), percent))
    rows = store.kept(rows.select("band", "rep", "n", "pos"), "keys-in-reach")
    store.drop(keys)
    return rows


def _judged(docs: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    """(doc_id, at, n_shingles, component_id, kept) of every row."""
    threshold = percent / 100
    sketches = store.kept(sketch(docs, size, text, key), "sketches")
    full = sketches.where(F.col("n_shingles") > 0)
    reps = full.groupBy("s1", "s2", F.col("n_shingles").alias("n"), "regs").agg(F.min("doc_id").alias("least"), F.min("at").alias("at"))
    reps = store.kept(reps.withColumn("rep", F.xxhash64("s1", "s2", "n")), "set-classes")

    keys = [F.xxhash64(F.lit(k), F.expr(f"substring(regs, {k * ROWS + 1}, {ROWS})")) for k in range(BANDS)]
    bands = reps.select("rep", "n", F.explode(F.array(*keys)).alias("band"))
    buckets = bands.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("_hub"), F.count("*").alias("m")).where(F.col("m") > 1)
    buckets = buckets.select("band", "m", F.col("_hub.rep").alias("hub"), F.col("_hub.n").alias("hub_n"))
    members = store.kept(bands.join(buckets.hint("shuffle_hash"), "band"), "buckets")
    alike = lambda n, m: F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9

    spent = [reps, members]  # what only the rounds read
    # the hub of each bucket, one pair a member: the likeliest hub first, then the others
    hubs = members.where((F.col("rep") != F.col("hub")) & alike(F.col("n"), F.col("hub_n"))).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    hubs = store.kept(hubs, "hub-pairs")
    tried = hubs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = store.kept(_plausible(hubs, reps, threshold), "plausible")
    likeliest = store.kept(first.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b")), "candidates")
    links = _verified(docs, likeliest, reps, size, percent, text, key)
    label = connected_components(links)
    spent += [hubs, first, likeliest, links, label]

    def joined(pairs: DataFrame) -> None:
        """Adds what links the kept `pairs`, and renews the components."""
        nonlocal links, label
        spent.append(pairs)
        if pairs.limit(1).count():
            found = _verified(docs, pairs, reps, size, percent, text, key)
            links = links.unionByName(found)
            label = connected_components(links)
            spent.extend((found, label))

    def torn(rows: DataFrame) -> DataFrame:
        """`rows` (band, rep, n, pos) of bands of several components, with c, m and the smallest set."""
        own = rows.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n", "pos", F.coalesce("component", "rep").alias("c"))
        apart = own.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct("n", "rep", "c")).alias("hub"), F.min("c").alias("_x"), F.max("c").alias("_y"))
        apart = apart.where(F.col("_x") != F.col("_y")).select("band", "m", F.col("hub.n").alias("hub_n"), F.col("hub.rep").alias("hub"), F.col("hub.c").alias("hub_c"))
        found = store.kept(own.join(apart.hint("shuffle_hash"), "band"), "torn-buckets")
        spent.append(found)
        return found

    for x in ("a", "b"):
        first = first.join(label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
    joined(store.kept(first.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"), "candidates"))

    rows = members.where(F.col("rep") != F.col("hub")).select("band", "rep", "n", F.lit(-1).alias("pos"))
    for keyed, last in ((False, False), (True, False), (True, True)):
        state = torn(rows).withColumn("whole", F.lit(last) | (F.col("m") <= LARGE))
        bits = ["lacks", "has", *BITS] if last else []
        if last:
            met = store.kept(state.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "large-keys")
            bound = _differences(docs, met, reps, size, text, key)
            state = state.join(bound, ["rep", "hub"])
            spent += [met, bound]
        other = state.select("band", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"), F.col("pos").alias("pos_b"), *[F.col(x).alias(f"{x}_b") for x in bits])
        pairs = state.where("whole").join(other, "band").where((F.col("rep") < F.col("b")) & (F.col("c") != F.col("c_b")) & alike(F.col("n"), F.col("n_b")))
        if keyed:
            pairs = pairs.where(_in_reach(F.col("n"), F.col("pos"), F.col("n_b"), percent) & _in_reach(F.col("n_b"), F.col("pos_b"), F.col("n"), percent))
        if last:
            pairs = pairs.where(_most_shared("n", "", "_b") * (1 + threshold) >= threshold * (F.col("n") + F.col("n_b")) - 1e-9)
        pairs = pairs.select("rep", "b")
        if keyed and not last:
            to_hub = state.where(~F.col("whole") & (F.col("c") != F.col("hub_c")) & alike(F.col("n"), F.col("hub_n")))
            pairs = pairs.unionByName(to_hub.select("rep", F.col("hub").alias("b")))
        pairs = pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
        pairs = store.kept(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        spent.append(pairs)
        tried = tried.unionByName(pairs)
        joined(store.kept(_plausible(pairs, reps, threshold).select("a", "b"), "candidates"))
        rows = state.where(~F.col("whole")).select("band", "rep", "n", "pos")
        if last or not rows.limit(1).count():
            break
        if not keyed:
            wanted = store.kept(torn(rows).select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct(), "large-buckets")
            rarest = _rarest(docs, wanted, reps, size, percent, text, key)
            rows = _keyed(rarest, percent)
            spent += [wanted, rarest, rows]

    known = store.kept(reps.select("s1", "s2", "n", "rep", "least").join(label.withColumnRenamed("node", "rep"), "rep", "left"), "classes")
    store.drop(*spent)
    # a class without links is named by its own smallest key
    names = known.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("_name"))
    known = known.join(names, "component", "left")
    name = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("_name"))
    known = known.select("s1", "s2", F.col("n").alias("n_shingles"), name.alias("_c"), F.lit(True).alias("_known"))
    joined = sketches.select("doc_id", "at", "n_shingles", "s1", "s2").join(known, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("_known"), F.col("_c")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "at", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return _judged(docs, size, percent, text, key).drop("at")


def without_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that are kept, with all their columns: of each component those of the smallest key."""
    found = _judged(docs, size, percent, text, key)
    gone = store.kept(found.where(~F.col("kept")).select(F.col("at").alias("_gone")).distinct(), "duplicates")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, _row_hash(text, key) == F.col("_gone"), "left_anti")
