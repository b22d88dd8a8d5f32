import random

import pytest

WORDS = "the and of Thing erea onder ÉTÉ être ñu 42 x. y, zz! a-b".split()


@pytest.fixture(scope="session")
def noisy_docs():
    """Small documents with exact copies, near copies, shared passages, empty
    texts and nulls: ``(doc_id, text)``."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    passage = text(60)
    docs = []
    for i in range(60):
        body = text(rng.choice([1, 2, 3, 5, 40, 120]))
        if i % 7 == 0:
            body = body + "\n" + passage + "\n" + text(5)
        if i % 11 == 3 and docs:
            body = (docs[-1][1] or "").upper()
        if i % 13 == 4 and docs:
            body = (docs[rng.randrange(len(docs))][1] or "") + " " + text(1)
        docs.append((i * 3 + 1, body))
    docs += [(500, ""), (501, None), (502, "  \n"), (503, ""), (7, docs[2][1]), (7, docs[2][1]), (None, docs[2][1]),
             (None, None), (504, "é" * 30 + "日本" * 20), (505, "zz " + "é" * 30 + "日本" * 20), (506, text(4000)),
             (507, docs[0][1])]
    return docs


@pytest.fixture()
def docs_frame(spark, noisy_docs):
    """The same with extra columns whose names clash with the operators'."""
    rows = [(d, t, "x", 1, True, "s") for d, t in noisy_docs]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, fp int, kept boolean, component string")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
