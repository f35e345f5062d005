"""Strings built by doubling and their mirrors, which polynomials modulo a power of two can't tell apart."""

import hashlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quillspark.llm import ngramjoin, shared, suffixdedup, transducer  # noqa: E402
from quillspark.llm.bytebpe import Encoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def doubled(n, a="a", b="b"):
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_ids(n):
    words = [*doubled(n)]
    ids, at = Encoder(PATH).encode(words)
    library = Tokenizer.from_file(PATH)
    for k, w in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(w, add_special_tokens=False).ids


def test_hashes_of_words_and_spans():
    words = [w for n in (64, 256, 1024, 2048) for w in doubled(n)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = shared.spans(data, np.array([0, len(data)]))
    found = shared.hash_words(data, start, end)
    assert len(set(found.tolist())) == len(words)
    # the same bytes have the same hash wherever they stand
    again = np.frombuffer(("some words before " + " ".join(reversed(words))).encode(), np.uint8)
    start, end, _ = shared.spans(again, np.array([0, len(again)]))
    assert set(shared.hash_words(again, start, end).tolist()) >= set(found.tolist())


def test_hashes_of_many_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 60_000).astype(np.uint8)
    at = np.arange(len(data) - 30)
    for values in (data, data.astype(np.uint64)):
        codes = shared.span_hash(shared.prefix_hash(values), at, at + 30)
        texts = [data[i : i + 30].tobytes() for i in at]
        assert len(set(codes.tolist())) == len(set(texts)) == len(set(zip(codes.tolist(), texts, strict=True)))


def test_documents(spark):
    x, y = doubled(1024)
    rows = spark.createDataFrame([(1, x), (2, y), (3, f"{x} one"), (4, f"{y} one")], "doc_id long, text string")
    assert {tuple(r)[::2] for r in ngramjoin.similar_components(rows).collect()} == {(i, i) for i in (1, 2, 3, 4)}
    library = Tokenizer.from_file(PATH)
    for r in transducer.round_trip(rows, PATH).collect():
        text = {1: x, 2: y, 3: f"{x} one", 4: f"{y} one"}[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(text, add_special_tokens=False).ids, "<u4")).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_spans_of_mirrored_blocks(spark):
    """200-byte strings of mirrored blocks: only those that are equal go."""
    x, y = doubled(128)
    texts = [x + y[:80], y + x[:80], x + y[:80], x + x[:80], y + y[:80], "q" + y + x[:79]]
    got = {r.doc_id: r.n_removed for r in suffixdedup.dedup_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        gone = set()
        for p in range(len(t) - 199):
            if sum(u[q : q + 200] == t[p : p + 200] for u in texts for q in range(len(u) - 199)) > 1:
                gone |= set(range(p, p + 200))
        want[i] = len(gone)
    assert got == want and want[0] == 208
