import public_tokenizers
import pytest
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use for columns of their own.
CLASHING = ["key", "row", "part", "n", "node", "label", "score", "_again", "shard", "x", "start",
            "length", "found", "size", "bucket", "postings", "n_entities"]

SOME = "the quick brown fox jumps over the lazy dog while nine more animals watch it from the hill"
EDGE = [
    (3, None), (1, ""), (2, " \n\t"), (5, SOME), (5, SOME), (None, SOME), (None, None),
    (7, SOME.upper() + " today"), (9, "x"), (11, "Ünïcode ﬀ ́ 'tis <|endoftext|> İ 日本"),
    (12, "lorem ipsum " * 9000), (13, "z" * 120_000), (14, "a\x00b \x01 c\x1fd"),
]


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(PATH)


def make(spark, rows, clash: bool = True):
    """Documents with the usual columns and some whose names clash."""
    df = spark.createDataFrame(
        [(i, t, "en", "src0", len(t or "")) for i, t in rows], COLUMNS
    )
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df


@pytest.fixture(scope="session")
def edge(spark):
    return make(spark, EDGE).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])
