import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, evidence double, score double"


def texts():
    """Nulls, empty and long texts, ties, repeated rows, copies with small changes, odd characters."""
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "er", "thé", "ou", "ß", "in", "on"]) for _ in range(r.randrange(1, 4)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    out = [None, "", " \n\t ", "one", "One", "two words", "a b c d e", "A B C D E", "x" * 3000, "word " * 2000]
    out += base
    for b in base[:4]:
        w = b.split()
        for k in (1, 2, 3, 6):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    out += [base[0], base[0].upper(), base[1] + "\n" + base[1], "<|endoftext|> a <|endoftext|>", "\\### Assistant: </turn> ok", "naïve café 中文 🙂 it's they'll 123,456", "\xa0\x85nbsp em"]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", None][i % 3], 7, 0.5, 0.5) for i, t in enumerate(texts())]
    rows += [rows[5], rows[12], (None, "no id here at all", "en", "s0", 1, 0.0, 0.0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
