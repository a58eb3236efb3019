"""Small documents that hold every awkward case at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
POEM = "the cat sat on the mat and looked at the moon\nwhile all the dogs of the town slept under old trees\nand nobody said a word until morning came"
LONG = " ".join(f"word{i % 977} and other{i % 1013}" for i in range(20_000))
ROWS = [
    (1, POEM, "en", "a"),
    (2, POEM, "en", "a"),
    (3, "Another start.\n" + POEM + "\nAnother end.", "en", "b"),
    (4, None, "en", "b"),
    (5, "", None, None),
    (6, " \t\r\n\x0b ", "en", None),
    (7, LONG, "en", "hot"),
    (8, LONG + " end", "en", "hot"),
    (9, "12 34 -- 56", "en", "hot"),
    (10, "der Hund und die Katze gehen über die Straße und schlafen dann unter dem Baum", "de", "c"),
    (11, "der Hund und die Katze gehen über die Straße und schlafen dann unter dem Baum", "de", "c"),
    (11, "der Hund und die Katze gehen über die Straße und schlafen dann unter dem Baum", "de", "c"),
    (None, "no id here but a few words that nobody else has written down so far", None, "c"),
    (None, None, None, None),
    (12, "ab " * 400, "en", "hot"),
    (13, "é𝄞ß" * 60, "fr", "é"),
]


def frame(spark: SparkSession, rows=ROWS, clash: bool = True) -> DataFrame:
    """The rows as documents, with extra columns whose names the operators use themselves."""
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    if clash:
        names = ["row", "k", "ord", "th", "n", "size", "start", "node", "first", "kept", "copies", "shard", "slot", "lang_pred", "score", "target", "h", "sha", "turn", "draw", "cuts", "chunk", "_source", "_coin", "runs", "collapsed", "n_words", "n_features", "weight", "rank", "label", "_down", "_id"]
        docs = docs.withColumns({name: F.lit(f"own {name}") for name in names})
    return docs


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
