import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéñß中") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(300)
    rows = [(i, text(r.randint(1, 60)), "en", f"s{i % 4}", 1) for i in range(40)]
    rows += [(40 + i, base + " " + word(), "en", "s0", None) for i in range(12)]
    rows += [(60, base, "en", "s1", 1)] * 5 + [(61, None, None, None, None), (62, "", "en", None, 0), (63, " \t\n ", "en", "", 3), (None, "no id here", "en", "s2", 1), (None, None, None, None, None)]
    rows += [(70, text(30_000), "en", "s3", 9), (71, "x" * 70_000, "en", "s3", 9), (72, "a  b\n\nc <|endoftext|> d   e it's 12,3", "en", "s1", 5), (73, "One", "en", "s1", 3), (74, "one TWO", "en", "s1", 3), (75, "one two", "en", "s1", 3)]
    names = ["h", "t", "k", "id", "size", "taken", "target", "fp", "fingerprint", "component_id", "row", "bits", "w", "key", "rank", "start", "ids", "digest", "first", "rest", "times", "level"]
    out = spark.createDataFrame(rows, DOCS)
    for n in names:
        from pyspark.sql import functions as F

        out = out.withColumn(n, F.lit("clash"))
    return out.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
