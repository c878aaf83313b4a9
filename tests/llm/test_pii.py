import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import pii
from tests.llm.conftest import CLASHES, EDGE

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB019..@@ +-()é_%", max_size=60))
def test_rules_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_stay_linear():
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == [] and pii.base_spans("@" * 100_000) == []


def test_field_on_held_out_rows():
    field = pii.default_field()
    held = pii.labelled(seed=77, rows=300)
    found = pii.tokens([t for t, _ in held])
    chains = [np.flatnonzero(found.row == k) for k in range(len(held))]
    labels = field.viterbi([found.features[c] for c in chains])
    right = sum((y == pii.gold(found, c, spans)).all() for (_, spans), c, y in zip(held, chains, labels))
    assert right >= 0.93 * len(held)


def test_viterbi_equals_exhaustive_search():
    rng = np.random.default_rng(6)
    field = pii.Field(rng.normal(size=(pii.SLOTS, len(pii._NAMES), pii.LABELS)), rng.normal(size=(pii.LABELS + 1, pii.LABELS)))
    chains = [rng.integers(0, 20, (n, pii.SLOTS)) for n in (1, 2, 3, 4, 4, 3)]
    for x, y in zip(chains, field.viterbi(chains)):
        emitted = field.scores(x)
        best = max(itertools.product(range(pii.LABELS), repeat=len(x)), key=lambda z: sum(emitted[t, z[t]] + field.transition[z[t - 1] if t else pii.LABELS, z[t]] for t in range(len(x))))
        assert tuple(y) == best


def test_tokens_of_whole_texts():
    texts = ["Ab 12-x", "", "é1 _q", "a" * 300 + "9"]
    found = pii.tokens(texts)
    want = [(k, m.start(), m.end()) for k, t in enumerate(texts) for m in re.finditer(r"[^\W\d_]+|\d+|[^\w\s]|_", t)]
    assert list(zip(found.row.tolist(), found.starts.tolist(), found.ends.tolist())) == want
    many = pii.tokens(["word " * 50 + "12 " + "word " * 50])
    assert many.open.sum() == 2 * pii.OPEN + 1
    alone = pii.tokens([texts[2]])
    assert (alone.features == found.features[found.row == 2]).all()


#: Written by hand, from no template: a form, and what must be found in it.
FORMS = {
    "415.555.2671": "415.555.2671", "call 555 123 4567 now": "555 123 4567", "ring 020 7946 0958 tonight": "020 7946 0958", "write to jane (at) example (dot) org now": "jane (at) example (dot) org", "call (555) 123-4567 today": "(555) 123-4567",
    "my card 4111.1111.1111.1111 ok": "4111.1111.1111.1111", "mail: john.smith @ firm.co.uk": "john.smith @ firm.co.uk", "ph: 1-800-555-0199": "1-800-555-0199", "maria[at]uni-bonn[dot]de": "maria[at]uni-bonn[dot]de", "192[.]168[.]1[.]10": "192[.]168[.]1[.]10",
}
NONE = ["on 2021-03-04 at 12:30:45", "version 1.2.3.", "$1,234.56 in 2019, 300 people", "isbn 978-3-16-148410-0", "order 555 1234 shipped", "pi is 3.14159 26535 89793", "123e4567-e89b-12d3-a456-426614174000", "He was at home. Dot was at work.", "see pages 100-120, 1990-1995", "lat 48.8584, 2.2945", "meet me at lunch at noon", "@anna 12 likes", "scores were 3-1 and 2-2, 45% of 1,200", "phone 12345"]


def test_everyday_forms():
    found = pii.find([*FORMS, *NONE], pii.default_field())
    got = {t: [t[a:b] for a, _, b in every] for t, (_, every) in zip([*FORMS, *NONE], found)}
    assert got == {t: [x] for t, x in FORMS.items()} | {t: [] for t in NONE}


def test_field_adds_and_rules_stay():
    texts = ["write to jane (at) example (dot) org now", "call (555) 123-4567 today", "a@b.co 1.2.3.4 +1 234 567 8901", "clean words at the end of 12 days", ""]
    found = pii.find(texts, pii.default_field())
    assert [pii.KINDS[k] for _, k, _ in found[0][1]] == ["email"] and found[0][0] == []
    assert [pii.KINDS[k] for _, k, _ in found[1][1]] == ["phone"]
    assert [pii.KINDS[k] for _, k, _ in found[2][0]] == ["email", "ip", "phone"]
    assert found[3][1] == [] == found[4][1]
    assert all(set(base) <= set(every) for base, every in found)


def test_rows(documents):
    rows = [*EDGE, (50, "😀 a.b@c.de, 10.0.0.1 and 4111 1111 1111 1111; +49 (30) 1234567"), (51, "ring 020 7946 0958")]
    _, df = documents(rows, CLASHES)
    got = pii.personal_data(df)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5 + ["string"] * 2 + ["bigint"]
    want = []
    for key, t in rows:
        base = brute(t or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((str(key), *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(said.encode()).hexdigest()))
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == sorted(want)
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in found)
    assert {r.doc_id: r.n_spans for r in found if r.doc_id in (50, 51)} == {50: 4, 51: 1}
    assert pii.personal_data(df.limit(0)).count() == 0
