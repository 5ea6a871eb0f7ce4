import random

import pytest

COMMON = "the and of to in that it was for on are with as they be at one have this from".split()


def words(rng, n):
    return " ".join(rng.choice(COMMON) + rng.choice(["", "s", "ing", "ed", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, nulls, empties, repeated rows and a long text; the columns clash with inner names on purpose."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        rows.append((i, words(rng, rng.randint(3, 120))))
    base = words(rng, 200)
    for i in range(40, 48):
        own = base.split()
        own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(50, base), (51, base), (51, base), (52, None), (53, ""), (54, " \n\t "), (55, "one two"), (56, "One\x0bTwo"), (None, words(rng, 30)), (57, words(rng, 5000)), (58, "a " * 300), (59, "line one\nline one\n\nline two %% ##\n")]
    return [(i, t, ["en", "de", None][n % 3], ["a", "b", None][n % 3], n, 1.5, "x") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, token string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1 if i % 4 else 0, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 0), (7, None, None), (999, 1, 1), (5, 2, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
