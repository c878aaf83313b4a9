import random

import numpy as np

from lodestrata.llm import toxicity
from tests.llm.conftest import CLASHES, EDGE


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    lexicon = {"stupid": 3.0, "moron": 2.0, "disgusting": 4.0, "bad": 1.0}
    auto = toxicity.Automaton(lexicon)
    allowed = {"stupid": 1, "moron": 1, "disgusting": 2, "bad": 0}
    r = random.Random(4)
    for _ in range(3000):
        w = list(r.choice(list(lexicon)))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            op = r.random()
            if op < 0.4:
                w.insert(k, r.choice("abstx1"))
            elif k < len(w) and op < 0.7:
                del w[k]
            elif k < len(w):
                w[k] = r.choice("abstx1")
        w = "".join(w)
        d = {t: distance(w, t) for t in lexicon}
        assert (auto.match(w)[0] > 0) == (w in lexicon)
        assert any(auto.match(w)) == any(d[t] <= allowed[t] for t in lexicon)


def test_short_words_of_strong_evidence_are_found_misspelled():
    counts = [("scum", 90, 0), ("rare", 2, 0), ("both", 60, 50), ("scu*", 90, 0)]
    assert toxicity.strong_terms(counts, 350, 1500) == {"scum", "scu*"}
    auto = toxicity.Automaton({"scum": 7.0, "rare": 3.0}, frozenset({"scum"}), frozenset({"scam"}))
    assert auto.match("scum") == (7.0, 0.0, 0.0)
    assert all(auto.match(w) == (0.0, 0.0, 7.0 * 0.75) for w in ("scuum", "scvm", "scm", "scun"))
    assert not any(any(auto.match(w)) for w in ("scam", "scvn", "rarer", "rxre", "sc"))


def test_misspelled_short_word_alone_is_toxic(spark, documents):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["an", "re", "ti", "ble", "en", "ou"]) for _ in range(3))
    rows, labels = [], []
    for k in range(400):
        body = [word() for _ in range(30)]
        if k % 4 == 0:
            body[5] = r.choice(["scum", "scum", "worthless"])
        rows.append((k, " ".join(body)))
        labels.append((k, int(k % 4 == 0)))
    rows += [(900, "anre tible scuum anti"), (901, "anre tible scvm anti"), (902, "anre tible anti")]
    _, df = documents(rows)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(df, model).where("doc_id >= 900").collect()}
    assert got == {900: 1, 901: 1, 902: 0}


def test_quotation_weighs_less():
    auto = toxicity.Automaton({"moron": 3.0})
    one = lambda t: auto.features([t])[0]
    assert one('he wrote "moron" in the quote')[0] == 0 < one("what a moron he is")[0]
    assert one("you moron")[0] > one("the moron")[0]


def plain_words(text):
    import re

    return re.findall(r"[^\W_]+(?:[*@$'’-]+[^\W_]+)*|[\"“”«»]", text.lower())


def test_words_and_features_equal_a_plain_walk():
    r = random.Random(8)
    lexicon = {"moron": 3.0, "stupid": 2.0, "bad": 1.0, "idiot*": 4.0}
    auto = toxicity.Automaton(lexicon)
    vocabulary = ["moron", "mor0n", "stu-pid", "stupd", "bad", "IDIOTIC", "you", "said", '"', "«", "a_b", "x", "it's", "--", "\n", "é", "tú", "İx", "12", "m@ron"]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 40))) for _ in range(200)] + ["", "moron", "-moron-", "moron--stupid"]
    many = auto.features(texts)
    for t, x in zip(texts, many):
        found = toxicity.said([t])
        words = plain_words(t)
        assert [found.word(k) for k in range(len(found.starts))] == words
        assert (auto.features([t])[0] == x).all()
        sums, most = [0.0] * 3, [0.0] * 3
        for k, w in enumerate(words):
            exact, fuzzy, near = auto.match(w)
            if w in '"«' or not (exact or fuzzy or near):
                continue
            left, right = words[max(0, k - 8) : k], words[k + 1 : k + 9]
            quoted = bool({'"', "«"} & set(left)) and bool({'"', "«"} & set(right))
            factor = (0.3 if "said" in left + right else 0.6) if quoted else 1.2 if {"you", "tú"} & set(left[-3:] + right[:3]) else 1.0
            for j, v in enumerate((max(exact, near) * factor, fuzzy * factor)):
                j = 2 if quoted else j
                sums[j] += v
                most[j] = max(most[j], v)
        want = [*np.log1p(sums), *most, (sums[0] + sums[1]) / (20 + len(words))]
        assert np.allclose(x, want)


def test_scores_equal_brute_force(spark, documents):
    """The model's scores of a small table, from its lexicon by plain edit distance."""
    model = toxicity.Model({"pathetic": 2.0, "dog": 1.0}, np.zeros(7), np.ones(7), np.arange(1, 8) / 7, -1.0, frozenset({"pathetic"}))
    rows = [(k, t) for k, t in enumerate(["pathetic dog", "patetic", "a dog here", "clean", "", None, "patheticc dogg"])]
    _, df = documents(rows)
    got = {x.doc_id: x.score for x in toxicity.toxicity(df, model).collect()}
    for key, t in rows:
        sums, most = [0.0] * 3, [0.0] * 3
        for w in plain_words(t or ""):
            weights = [(model.lexicon[x] * 0.75 ** distance(w, x), distance(w, x) > 0) for x, room in (("pathetic", 1), ("dog", 0)) if distance(w, x) <= room]
            for v, j in weights:
                sums[j] += v
                most[j] = max(most[j], v)
        x = np.array([*np.log1p(sums), *most, (sums[0] + sums[1]) / (20 + len(plain_words(t or "")))])
        assert abs(got[key] - 1 / (1 + np.exp(1 - x @ np.arange(1, 8) / 7))) < 1e-12


def test_evidence_rule_is_one_at_every_size():
    counts = [("often", 40, 1), ("rare", 3, 0), ("both", 200, 400)]
    assert set(toxicity.lexicon(counts, 350, 1500)) == {"often"} == set(toxicity.lexicon([(t, 10 * a, 10 * b) for t, a, b in counts if t != "rare"], 3500, 15000))
    assert toxicity.lexicon([("verylong" * 6, 40, 0), ("ab", 40, 0)], 350, 1500).keys() == {"verylong" * 6, "ab"}


def test_learns_and_keeps_clean(spark, documents):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["an", "re", "ti", "ble", "en", "ou"]) for _ in range(3))
    rows, labels = [], []
    for k in range(400):
        body = [word() for _ in range(30)]
        if k % 4 == 0:
            body[5] = r.choice(["scumbag", "worthless", "pathetic"])
        rows.append((k, " ".join(body)))
        labels.append((k, int(k % 4 == 0)))
    rows.append((999, "anre tible wortless anti"))
    _, df = documents(rows + EDGE, CLASHES)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    got = toxicity.toxicity(df, model).collect()
    assert len(got) == len(rows) + len(EDGE) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and 10 <= x.doc_id < 400]
    assert held and sum(x.predicted == int(x.doc_id % 4 == 0) for x in held) >= 0.95 * len(held)
    assert next(x for x in got if x.doc_id == 999).predicted == 1
    assert next(x for x in got if x.doc_id == 1).predicted == 0
    left = toxicity.without_toxic(df, model)
    assert left.columns == df.columns and left.where("doc_id = 999").count() == 0 and left.where("doc_id = 1").count() == 2
    empty = toxicity.fit(df, marks.limit(0))
    assert {x.predicted for x in toxicity.toxicity(df, empty).collect()} == {0}
