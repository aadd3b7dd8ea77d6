import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def rows(n=60, seed=3):
    """Prose of a small vocabulary with copies, edited copies, shared passages, odd and missing texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    out = []
    for i in range(n):
        text = prose(rng.randint(1, 160))
        if i % 9 == 4:
            text = out[rng.randrange(len(out))][1]
        if i % 7 == 5:
            text = f"{text}. {passage}\n{prose(12)}"
        if i % 11 == 6:
            w = out[rng.randrange(len(out))][1]
            text = (w or "").replace(vocabulary[0], vocabulary[1], 1)
        out.append((i * 3, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(text or ""), "x"))
    out += [(500, None, None, None, None, None), (501, "", "en", "a", 0, "y"), (502, "  \n\t ", "fr", "b", 5, "y"), (503, "漢字 😀 ok", "en", "a", 7, "y"), (504, prose(4000), "fr", "b", 9, "z")]
    out += [out[0], out[0], (None, "lost words of nobody", "en", "a", 20, "n"), (None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Without repeated or missing ids."""
    seen = {}
    for r in rows():
        if r[0] is not None:
            seen.setdefault(r[0], r)
    return spark.createDataFrame(list(seen.values()), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """With repeated rows and missing ids."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
