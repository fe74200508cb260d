import random

import pytest

WORDS = [a + b for a in ("ton", "re", "si", "ma", "lu", "ven", "dor", "pa") for b in ("ka", "lo", "mi", "ra", "tes", "no", "bel", "un")]


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    r = random.Random(9)
    rows = [(i, prose(i), "en", "s1", 1) for i in range(30)]
    for i in range(30, 60):  # near copies of a few
        words = prose(i % 5).split()
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        rows.append((i, " ".join(words), "en", "s1", 1))
    rows += [(60 + i, prose(100 + i, 20) + " " + prose(7, 40) + "\n\t" + prose(200 + i, 15), None, "s1", 1) for i in range(6)]
    rows += [(70 + i, prose(3), "fr", "s1", 1) for i in range(12)]  # exact copies
    rows += [(90, None, "en", None, None), (91, "", "en", "s", 0), (92, "  \n ", "en", "s", 3), (93, "one", "en", "s", 3), (94, "one", None, "s", 3), (95, "12 34 !?", "en", "s", 8)]
    rows += [(96, prose(4, 60_000), "en", "s", 1), (97, "x" * 300_000, "en", "s", 1), (98, "a " * 3000, "en", "s", 1), (None, prose(2), "en", "s", 1), (98, "a " * 3000, "en", "s", 1)]
    rows += [(99, "mél Ünï çodé 　 wide 漢字 " + prose(8, 20), "de", "s", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The hard rows, with columns whose names clash with those used inside the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows, SCHEMA).repartition(5)
    clashing = ("node", "component", "key", "_block", "_bucket", "slot", "shard", "score", "_s", "_p", "_l", "bands", "set_digest", "label", "_x", "_q")
    return df.select("*", *[F.lit("clash").alias(c) for c in clashing])
