import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.fixture
def odd(docs):
    """Null, empty, repeated and very long texts, a null id, clashing extra columns."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    rows = [(1, "a plain text of several words, and a few more of them"), (2, None), (3, ""), (4, "same words here and there today"), (4, "same words here and there today"), (5, long), (6, "é ²½ \x1c日本語 <|endoftext|> x"), (None, "no id at all")]
    return docs(rows).withColumns({c: F.lit(7) for c in ("slice", "rank", "block", "word", "count", "fingerprint", "size", "shard", "uid", "score", "component_id", "pid", "key", "digest", "spans", "kept", "base", "values", "words", "tie", "ghost", "next", "anchors", "hashes", "copies", "root", "node", "head", "y", "data")})
