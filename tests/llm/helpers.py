"""Small document tables with everything odd in them."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, anchor long, bucket long, __text string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n)) + "."


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src", None if t is None else len(t), "x", 1, 2, "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    base = prose(1, 120)
    return [base, base, base.replace("alpha", "omega", 1), None, "", "   \n ", "one", "é ü ß 日本", prose(2, 4000), prose(3, 60) + " " + base, prose(4, 60) + " " + base, "a " * 400]
