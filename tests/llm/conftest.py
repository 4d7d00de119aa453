import random

import pytest
from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def documents(spark, rows, extra=False):
    """Documents from (doc_id, text[, lang]) tuples; ``extra`` adds columns whose
    names clash with those that the operators make."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        for c in ("keep_id", "node", "n", "score", "_id", "_text", "norm", "block", "role", "keys", "gid", "place", "k_text", "h", "salt", "held_out"):
            df = df.withColumn(c, F.lit("x"))
    return df


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
