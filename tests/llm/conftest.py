import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, runs int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, ties, repeated rows and columns whose names the operators use too."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    base = [text(rng.randrange(1, 12)) for _ in range(30)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4]) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5], "en", "a") for i in range(12)]  # copies
    rows += [(200 + i, base[7].replace(words[i], words[i + 1], 1) + " tail" * i, "en", "b") for i in range(10)]
    rows += [(300, None, "en", "a"), (301, "", "en", None), (302, " \n\t ", None, "b"), (303, "one", "de", "c"), (304, "a b", "de", "c")]
    rows += [(305, "spam eggs " * 300, "en", "a"), (306, text(500), "de", "b"), (307, "é" * 500 + " ▁ Ünï 中文 \U0001f600", "fr", "c"), (None, base[0], None, None)]
    rows += [(5, base[5], "de", "b")] * 2  # repeated rows
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), "x", 1) for d, t, lang, s in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
