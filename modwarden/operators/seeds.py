"""Orders and caps over word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modwarden.functions import text as X


def round_robin(words: DataFrame, limit: int, word_col: str = "word", skip: list[str] | None = None) -> DataFrame:
    """The first `limit` words of 4 to 24 letters, one of each first letter in turn; other starts come last in a turn.

    The limit is the feature: a seed list.  Only `limit` rows a letter can matter, so each letter keeps no more
    before the global order."""
    w = words.select(F.lower(F.trim(F.col(word_col))).alias("word")).where(F.length("word").between(4, 24)).distinct()
    if skip:
        w = w.where(~F.col("word").isin(*skip))
    first = F.substring("word", 1, 1)
    w = w.withColumn("bucket", F.when(first.between("a", "z"), first).otherwise(F.lit("~")))
    turn = w.withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy("word"))).where(F.col("turn") <= limit)
    return turn.orderBy("turn", "bucket").limit(limit)


def per_letter_cap(words: DataFrame, limit: int, word_col: str = "word", order_col: str = "line_no") -> DataFrame:
    """A clean lexicon: of each letter the first (limit + 25) / 26 + 512 words by line, then `limit` of them in turns."""
    w = words.select(X.lexicon_word(F.col(word_col)).alias("word"), F.col(order_col).alias("line")).where("word is not null").groupBy("word").agg(F.min("line").alias("line"))
    w = w.withColumn("letter", F.substring("word", 1, 1))
    cap = (limit + 25) // 26 + 512
    turn = w.withColumn("turn", F.row_number().over(Window.partitionBy("letter").orderBy("line", "word"))).where(F.col("turn") <= cap)
    return turn.orderBy("turn", "letter").limit(limit)
