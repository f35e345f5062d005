"""The language model sees the order of words."""

import random
import zlib

from quillspark.llm import ngramlm


def test_held_out_texts_score_above_their_shuffled_copies(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghiklmnoprstuvz", k=rng.randrange(2, 9))) for _ in range(200)]
    following = {w: rng.sample(words, 4) for w in words}

    def said(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(following[out[-1]]))
        return out

    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(said(80))) for i in range(600) if i not in held]
    pairs = list(zip(held[0:40:2], held[1:40:2], strict=True))
    for own, other in pairs:
        text = said(60)
        rows += [(own, " ".join(text)), (other, " ".join(rng.sample(text, len(text))))]
    got = {r["doc_id"]: r for r in ngramlm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for own, other in pairs:
        assert got[own]["held_out"] and got[other]["held_out"]
        assert abs(got[own]["base_score"] - got[other]["base_score"]) < 1e-9
        assert got[own]["score"] > got[other]["score"] + 10
