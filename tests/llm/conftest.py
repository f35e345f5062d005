import random

import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=5):
    """Small documents with nulls, empty and long texts, copies, near copies, repeated runs and odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghiklmnoprstuvz", k=rng.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage, lines = say(70), [say(8) for _ in range(4)]
    long = "\n".join(say(40) for _ in range(300))
    texts = [None, "", " \t\n", "one", "One two", "don't we'll It'S  x\n\n'tis <|endoftext|> end", "é　中文 1²3 \U0001f600!!", "a" * 700, "ab " * 300, long, long]
    for _ in range(30):
        base = say(rng.randrange(60, 200))
        texts += [base, base + " " + say(3), base.upper(), f"{say(30)} {passage} {say(30)}", "\n".join([say(9), *lines, say(9)]), "\n".join([say(9), lines[0], say(9)])]
    texts += [texts[12]] * 5
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, (7, "a" * 700, "en", None, 700), (None, "no id here " * 30, None, None, 330), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(made(), EDGE).withColumnsRenamed({}).repartition(5)


@pytest.fixture(scope="session")
def rows():
    return made()
