import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import bpe, token_ids
from tests.llm.conftest import CLASHES, EDGE

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
LIB = tokenizers.Tokenizer.from_file(PATH)


def ids_of(text):
    return LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcé'sS 1½<|>endoftxΣß \x85\x1ć", max_size=40))
def test_both_encoders_equal_the_library(text):
    own = bpe.encoder(PATH)
    assert own.encode(text) == ids_of(text)
    assert own.decode(ids_of(text)) == LIB.decode(ids_of(text), skip_special_tokens=False)
    assert token_ids.encoder(PATH).encode_many([text])[0].tolist() == ids_of(text)


def test_no_token_reaches_over_a_forced_cut():
    own = bpe.encoder(PATH)
    word = "naïveté" + "zzqx" * 5
    parts = own.fragments_of(word)
    assert len(parts) > 1 and own.encode(word) == ids_of(word)


def test_bpe_rows(documents):
    _, df = documents(EDGE, CLASHES)
    rows = bpe.encode_decode(df, PATH, digests=True).collect()
    assert len(rows) == len(EDGE)
    want = sorted((str(k), len(ids_of(t or "")), hashlib.sha256(np.array(ids_of(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids_of(t or ""), skip_special_tokens=False).encode()).hexdigest()) for k, t in EDGE)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_ids.pack(v)
        assert len(control) == -(-n // 4)
        assert (token_ids.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()


def test_token_files(spark, documents, tmp_path):
    rows = [r for r in EDGE if r[0] is not None] + [(100 + k, " ".join(random.Random(k).choices(["the", "of", "thing", "ou"], k=k))) for k in range(40)]
    _, df = documents(rows, CLASHES)
    manifest = token_ids.write(df, PATH, f"file://{tmp_path}/ids", mb=0.001, block_mb=0.00005)
    assert manifest.count() > manifest.select("part").distinct().count() > 1
    got = token_ids.read(manifest).orderBy("start").collect()
    before = 0
    for (key, text), r in zip(sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")), got):
        ids = [*ids_of(text or ""), 1]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (key, before, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        before += len(ids)
    assert token_ids.read(token_ids.write(df.limit(0), PATH, f"file://{tmp_path}/none")).count() == 0


def test_many_texts_at_once_equal_the_library():
    r = random.Random(5)
    letters = "abcdefgé'ñ tiononthe.,!12Σß€"
    texts = ["".join(r.choices(letters, k=r.randint(0, 80))) for _ in range(300)] + ["<|endoftext|>x<|startoftext|>", "x" * 3000, "the" * 40 + " " + "thing" * 30, "\x00", ""]
    own = bpe.encoder(PATH)
    ids, starts, ends = own.encode_many(texts)
    raw, a, b = own.decode_many(ids, starts, ends)
    for k, t in enumerate(texts):
        assert ids[starts[k] : ends[k]].tolist() == ids_of(t)
        assert raw[a[k] : b[k]].tobytes().decode() == LIB.decode(ids_of(t), skip_special_tokens=False)
    assert own.decode([10**6, 5, 49406]) == LIB.decode([10**6, 5, 49406], skip_special_tokens=False)


def test_repeated_and_missing_document_ids(spark, documents, tmp_path):
    rows = [(None, "no key"), (None, None), *[(7, f"copy {k % 3}") for k in range(40)], (1, "first")]
    _, df = documents(rows)
    got = token_ids.read(token_ids.write(df, PATH, f"file://{tmp_path}/ids", mb=0.0005)).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None, None, 1] + [7] * 40
    assert sorted(list(x.ids) for x in got) == sorted([*ids_of(t or ""), 1] for _, t in rows)
    assert [x.start for x in got] == [sum(y.n_tokens for y in got[:k]) for k in range(len(got))]
