import random
import re

import numpy as np
import pytest

from lodestrata.llm import neardup, words
from lodestrata.llm.components import connected_components
from tests.llm.conftest import CLASHES, EDGE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*[w[k:] for k in range(size)]))


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for k, (key, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(key)
    return sorted((str(key), len(sets[k]), str(min((x for x in groups[find(k)] if x is not None), default=None))) for k, (key, _) in enumerate(rows))


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, families = [], []
    for k in range(n):
        if families and r.random() < 0.6:
            body = list(r.choice(families[-3:] if r.random() < 0.7 else families))
            for _ in range(r.randint(0, max(1, len(body) // 9))):
                body[r.randrange(len(body))] = r.choice(vocabulary)
        else:
            body = r.choices(vocabulary, k=r.randint(1, 60))
        families.append(body)
        rows.append((1000 - k, " ".join(x.upper() if r.random() < 0.1 else x for x in body)))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_classes_equal_brute_force(documents, size):
    rows = corpus(size, 220) + EDGE[:-1]
    _, df = documents(rows, CLASHES)
    got = neardup.near_duplicates(df, size).collect()
    keyed = [r for r in rows if r[0] is not None]
    want = [x for x in brute(keyed, size, 80)]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_large_torn_buckets_lose_nothing(documents, monkeypatch):
    """One origin with many copies at every distance, so hubs disagree and the bound is used."""
    monkeypatch.setattr(neardup, "LARGE", 3)
    r = random.Random(9)
    base = [f"v{k}" for k in range(60)]
    rows = [(500, " ".join(base))]
    for k in range(90):
        body = list(base)
        for _ in range(r.randint(1, 9)):
            body[r.randrange(60)] = f"x{r.randrange(40)}"
        rows.append((k, " ".join(body)))
    _, df = documents(rows)
    got = neardup.near_duplicates(df, 2).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 2, 80)


def test_no_pair_is_made_twice(documents, monkeypatch):
    """Far and near copies of one origin: what a hub or a bucket has ruled out isn't looked at again."""
    monkeypatch.setattr(neardup, "LARGE", 3)
    seen, plausible = [], neardup._plausible

    def watched(pairs, *rest):
        seen.extend((min(x.a, x.b), max(x.a, x.b)) for x in pairs.select("a", "b").collect())
        return plausible(pairs, *rest)

    monkeypatch.setattr(neardup, "_plausible", watched)
    r = random.Random(4)
    rows = []
    for k in range(60):
        body = [f"v{k}" for k in range(60)]
        for _ in range(r.randint(3, 20)):
            body[r.randrange(60)] = f"x{r.randrange(40)}"
        rows.append((k, " ".join(body)))
    _, df = documents(rows)
    got = neardup.near_duplicates(df, 2).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 2, 80)
    assert len(seen) == len(set(seen))


def test_rows_without_key_and_of_one_key_are_linked(documents):
    rows = corpus(11, 150)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else key, t) for k, (key, t) in enumerate(rows)]
    base = " ".join(f"b{k}" for k in range(80))
    rows += [(2001, base), (None, base + " more"), (None, base), (3001, base.replace("b", "c")), (3002, base.replace("b", "d")), (3002, base.replace("b", "c") + " more")]
    _, df = documents(rows, CLASHES)
    got = neardup.near_duplicates(df, 2).collect()
    want = brute(rows, 2, 80)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    left = [(r.doc_id, r.text) for r in neardup.without_duplicates(df, 2).collect()]
    assert len(left) == sum(c in ("None", k) for k, _, c in want)
    assert (None, base) not in left and (None, base + " more") not in left and (3002, base.replace("b", "d")) in left


def test_empty_table_and_stage(documents):
    rows = corpus(3, 40)
    _, df = documents(rows, CLASHES)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    left = neardup.without_duplicates(df)
    assert left.columns == df.columns
    kept = {k for k, _, c in brute(rows, 5, 80) if k == c}
    assert {str(r.doc_id) for r in left.select("doc_id").collect()} == kept


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64))))
    x, y = neardup.registers(a, np.array([0])), neardup.registers(b, np.array([0]))
    both = neardup.registers(np.union1d(a, b), np.array([0]))
    assert (neardup.merge(x, y) == both).all()
    est = neardup.similarity(x, y, np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert abs(est - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


def test_words_and_shingles():
    data = np.frombuffer("A b\tc\na B".encode(), np.uint8)
    h, first, _, _ = words.word_hashes(data, np.array([0, 6, 9]))
    assert list(first) == [0, 3, 5] and h[0] == h[3] and h[1] == h[4] and len({int(v) for v in h}) == 3
    s, at = words.shingles(h, first, 2)
    assert list(at) == [0, 2, 3] and s[0] == s[2]


def test_components(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90}
