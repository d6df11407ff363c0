import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, odd and empty texts."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    rows, passage = [], text(70)
    for i in range(60):
        rows.append((i * 3 + 1, text(rng.choice([1, 3, 4, 5, 6, 12, 13, 14, 40, 200]))))
    base = text(120)
    for i in range(40):  # near copies of one text, each with words of its own
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((500 - i, " ".join(w)))
    rows += [(600 + i, "The Same\tcopy of a short text, again and again") for i in range(30)]
    rows += [(700 + i, text(20) + "\n" + passage + " " + text(20)) for i in range(12)]
    rows += [(800, None), (801, ""), (802, " \t\n "), (803, "a b"), (804, "A B"), (805, text(30_000)), (806, "x " * 300), (807, "é ü ß " * 9)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, "xx", "src", 7, True, 3) for i, t in corpus]
    schema = "doc_id long, text string, lang string, source string, n int, kept boolean, vid long"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
