import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid int, band string, kept double, row string, leaked_id int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeéñ", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Random prose, near and exact copies, shared passages, one page of repeats, and awkward rows."""
    rng = random.Random(4)
    out = [words(rng, rng.randint(1, 300)) for _ in range(60)]
    passage = words(rng, 90)
    for i in range(0, 24):
        out.append(words(rng, 40) + " " + passage + " " + words(rng, 40))
    base = words(rng, 200).split()
    for i in range(20):
        copy = list(base)
        for _ in range(i // 3):
            copy[rng.randrange(len(copy))] = words(rng, 1)
        out.append(" ".join(copy))
    out += ["the cat " * 300, "x" * 1500, words(rng, 8000), None, "", "   \n\t", "one", "One  two", "one two", "ONE TWO THREE", out[3], out[3], out[70]]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With repeated rows, a null id, nulls elsewhere and columns whose names operators use themselves."""
    rows = [(i, t, None if i % 5 == 0 else "en", f"s{i % 3}", len(t) if t else None, 1, "b", 0.5, "r", 2) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, "a text without an id " * 3, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
