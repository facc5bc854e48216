"""Reports over channels, offenders and terms, derived from an events table.

An event of type `error` stands for a blocked message; its channel is user_id modulo the number of channels and the
event types stand for matched words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modwarden.functions import hashing, text

CHANNELS = 10


def messages(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("user_id") % CHANNELS).alias("channel_id"), F.col("event_type").alias("word"), (F.col("event_type") == "error").alias("blocked"), "value")


def channel_rollup(events: DataFrame) -> DataFrame:
    rows = messages(events).groupBy("channel_id").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("blocked").alias("blocked"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_event"))
    return rows.withColumn("block_rate", F.round(hashing.percent(F.col("blocked"), F.col("scanned")), 6))


def overview(events: DataFrame) -> DataFrame:
    rows = messages(events).agg(F.count(F.lit(1)).alias("scanned"), F.count_if("blocked").alias("blocked"), F.countDistinct("channel_id").alias("channels"))
    return rows.select(F.greatest("channels", F.lit(1).cast("long")).alias("channels"), "scanned", "blocked", F.round(hashing.percent(F.col("blocked"), F.col("scanned")), 6).alias("block_rate"))


def platforms(events: DataFrame) -> DataFrame:
    """Channels and messages by platform; the parity of a channel stands for its platform."""
    rows = messages(events).withColumn("platform", F.when(F.col("channel_id") % 2 == 0, F.lit("telegram")).otherwise(F.lit("discord")))
    return rows.groupBy("platform").agg(F.countDistinct("channel_id").alias("channels"), F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("blocked") & (F.col("word") != "")).alias("blocked"))


def offenders(events: DataFrame) -> DataFrame:
    """Per channel and user of a blocked message: violations, last day, and the most frequent word of all their messages
    (ties: the first in order)."""
    rows = messages(events)
    bad = rows.where("blocked").groupBy("channel_id", "user_id").agg(F.count(F.lit(1)).alias("violations"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))
    counts = rows.groupBy("channel_id", "user_id", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("channel_id", "user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")))["w"].alias("top_word"))
    return bad.join(top, ["channel_id", "user_id"]).withColumn("masked_word", text.first_letter_mask(F.col("top_word")))


def top_offenders(events: DataFrame, k: int) -> DataFrame:
    rows = offenders(events).orderBy(F.desc("violations"), "channel_id", "user_id").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("violations"), "channel_id", "user_id")))


def top_words(events: DataFrame, k: int) -> DataFrame:
    """The k most frequent words with their share of the most frequent one in whole percent."""
    rows = messages(events).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)
    return rows.withColumn("percent", F.floor(F.col("n") * 100 / F.max("n").over(Window.partitionBy())))


def recent(events: DataFrame, k: int) -> DataFrame:
    rows = messages(events).where("blocked").orderBy(F.desc("ts"), F.desc("event_id")).limit(k)
    return rows.select("event_id", "channel_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def distinct_offenders(events: DataFrame) -> DataFrame:
    return messages(events).where("blocked").agg(F.countDistinct("user_id").alias("offenders"))


def daily(events: DataFrame) -> DataFrame:
    return messages(events).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("scanned"), F.count_if("blocked").alias("blocked"))


def for_admin(rows: DataFrame, admins: DataFrame, user_id: int) -> DataFrame:
    """Rows of the channels that a user administers."""
    mine = admins.where(F.col("user_id") == user_id).select("channel_id")
    return rows.join(mine, "channel_id", "left_semi")


def confusion(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Confusion counts of blocked against labelled toxic, with precision, recall, F1 and F0.5."""
    rows = verdicts.join(labels.select("doc_id", "toxic"), "doc_id")
    hit, bad = F.col("verdict") == "block", F.col("toxic") == 1
    c = rows.agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    c = c.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f = lambda b2: ratio((1 + b2) * F.col("p") * F.col("r"), b2 * F.col("p") + F.col("r"))
    return c.select("tp", "fp", "fn", "tn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f(1.0), 6).alias("f1"), F.round(f(0.25), 6).alias("f05"))
