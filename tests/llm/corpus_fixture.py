import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, key long, component string"


@pytest.fixture(scope="session")
def fixture_rows():
    """Small corpus: copies, near copies, shared passages, nulls, empty and long texts, ties, repeated rows."""
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(120)
    out = [text(rnd.randrange(1, 200)) for _ in range(60)]
    out += [base, base, base.replace(" ", "  "), base.upper() + "."]
    for _ in range(12):
        words = base.split()
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        out.append(" ".join(words))
    out += [text(40) + " " + passage + " " + text(30) for _ in range(8)]
    out += ["", None, "   \n", "one", "two words", "one", "ab" * 400, "é" * 150 + "ß", text(6000), " ".join(["again"] * 300)]
    rows = [(i, t) for i, t in enumerate(out)]
    rows += [rows[3], (None, "no id here"), (None, base)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame([(i, t, None if i is None or i % 7 == 0 else "en", f"src{(i or 0) % 3}", None, "x", 1, "y") for i, t in fixture_rows], DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
