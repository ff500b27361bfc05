from __future__ import annotations

import random

import pytest

# Columns whose names clash with those the operators use inside.
EXTRA = ("row", "rid", "key", "node", "id", "h", "kept", "judged", "block", "spans")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents (doc_id, text) with extra columns of awkward names."""
    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, x) for i, x in rows], "doc_id long, text string").repartition(3)
        return df.select("*", *[F.lit("x").alias(c) for c in EXTRA])

    return make


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def corpus():
    """Random prose with copies, near copies, shared passages, nulls, empty, long and repeated rows."""
    rng = random.Random(7)
    texts = ["\n".join(sentence(rng, rng.randint(5, 90)) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    passage = sentence(rng, 61)
    rows = list(enumerate(texts))
    rows += [(100 + i, texts[i % 3]) for i in range(12)]  # copies
    for i in range(25):  # near copies
        words = texts[5].split(" ")
        words[rng.randrange(len(words))] = "zz"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{texts[20 + i]} {passage}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one"), (404, "Ab\x0bcd e"), (405, sentence(rng, 30_000)), (7, texts[7]), (7, texts[7]), (None, texts[8]), (None, None)]
    return rows
