"""The chain of the pipeline against plain versions of its stages, one after the other."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tokenizers import Tokenizer  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_chars long, row string, others string, n_words string, spans string, `a``b` string, kept string"


def said(rng, n):
    return " ".join("".join(rng.choices("abcdefghiklmnoprstuvz", k=rng.randrange(2, 9))) for _ in range(n))


def documents():
    rng = random.Random(8)
    lines = [said(rng, 12) for _ in range(3)]
    passage = said(rng, 70)
    texts = [None, "", "too short", said(rng, 4000)]
    for _ in range(12):
        base = said(rng, 150)
        texts += [base, base + " " + said(rng, 4), "\n\n".join([said(rng, 60), *lines, said(rng, 60)]), f"{said(rng, 60)} {passage} {said(rng, 60)}"]
    texts += [texts[4]] * 4
    return [(i, t, "en", None if t is None else len(t), "r", "o", "w", "s", "b", "k") for i, t in enumerate(texts)] + [(None, said(rng, 80), "en", 1, "r", "o", "w", "s", "b", "k")]


def without_lines(rows):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines = text.split("\n")
        at = [n for n, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k, n in enumerate(at):
            if len(lines[n].split()) >= 5 and seen.setdefault(lines[n], (i, n)) != (i, n):
                gone.add(n)
            if k + 1 < len(at):
                pair = (lines[n], lines[at[k + 1]])
                if seen.setdefault(pair, (i, n)) != (i, n):
                    gone |= {*range(n, at[k + 1] + 1)}
        out.append((i, "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    return out


def without_near_copies(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(text.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if rows[x][0] is not None and rows[y][0] is not None and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)), key=lambda r: rows[r][0])
                parent[b] = a
    return [r for k, r in enumerate(rows) if root(k) == k]


def without_strings(rows, size=200):
    seen = collections.Counter()
    for _, text in rows:
        b = text.encode()
        seen.update(b[p : p + size] for p in range(len(b) - size + 1))
    out = []
    for i, text in rows:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = True
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode()))
    return out


def test_chain(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = [(r[0], r[1]) for r in rows if len(WORD.findall(r[1] or "")) >= 50]
    steps = [plain, plain := without_lines(plain), plain := without_near_copies(plain), plain := without_strings(plain)]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        got = docs.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str), name
        assert all(tuple(r)[4:] == ("r", "o", "w", "s", "b", "k") for r in got)
        assert all(r["n_chars"] in (len(r["text"]), 1) for r in got)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: np.append(library.encode(t, add_special_tokens=False).ids, 1).astype("<u4") for i, t in plain}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    held = collections.defaultdict(list)
    for g in got:
        assert g["ids_crc32"] == zlib.crc32(tokens[g["doc_id"]][g["start"] : g["start"] + g["length"]])
        held[g["doc_id"]].append((g["start"], g["length"]))
    assert {i: sum(n for _, n in p) for i, p in held.items()} == {i: len(t) for i, t in tokens.items()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
