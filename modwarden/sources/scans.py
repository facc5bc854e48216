"""Scans of lexicon, corpus and message sources."""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modwarden import lexicon
from modwarden.functions import hashing
from modwarden.functions import text as X

#: Schema of a moderation database; `word` may be a string or an array and is read as JSON text.
DB_SCHEMA = "entries array<struct<match:string,word:string,tags:array<string>,category:string,severity:int>>, whitelist array<string>, slangMap map<string,string>"
MINED_SCHEMA = "total_contexts long, sources map<string,long>, records array<struct<source:string,toxicity_score:double,profane_terms:array<string>,context:string>>"


def lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """Trimmed non-empty lines of text files; with comments, lines that begin with # are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return rows.where(~F.col("line").startswith("#")) if comments else rows


def either(json_text: Column) -> Column:
    """The strings of a field that holds a string or an array of strings."""
    many = F.from_json(json_text, "array<string>")
    return F.when(json_text.startswith("["), many).when(json_text.isNotNull(), F.array(json_text)).otherwise(F.array().cast("array<string>"))


def moderation_db(raw: DataFrame, json_col: str = "value") -> dict[str, DataFrame]:
    """bad, short, aggressive and whitelist words of moderation databases, one JSON text a row; broken texts give nothing.

    Entries below severity 2 (default 3) are left out; variants are split at |; words of four or more letters are bad,
    shorter ones count if tagged as acronyms; slang keys of four or more letters are bad."""
    body = F.from_json(F.regexp_replace(F.col(json_col), "^﻿", ""), DB_SCHEMA, {"mode": "PERMISSIVE"})
    rows = raw.select(body.alias("b"))
    entries = rows.select(F.explode("b.entries").alias("e")).where("coalesce(e.severity, 3) >= 2")
    variants = F.flatten(F.transform(F.array_compact(F.concat(F.array("e.match"), either(F.col("e.word")))), lambda v: F.split(v, r"\|")))
    tags = F.transform(F.coalesce("e.tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    words = entries.select(F.explode(variants).alias("v"), tags.alias("tags")).select(F.regexp_replace(X.ascii_lower(F.trim("v")), "[^a-z0-9]", "").alias("word"), "tags").where("word <> ''")
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    short = words.where(F.length("word").between(2, 3) & F.arrays_overlap("tags", lit(lexicon.SHORT_TAGS)))
    slang = rows.select(F.explode(F.map_keys("b.slangMap")).alias("word")).select(F.regexp_replace(X.ascii_lower(F.col("word")), "[^a-z0-9]", "").alias("word"))
    bad = words.where(F.length("word") >= 4).select("word").unionByName(slang.where(F.length("word") >= 4))
    return {
        "bad": bad.distinct(),
        "short": short.select("word").distinct(),
        "aggressive": short.where(F.arrays_overlap("tags", lit(lexicon.AGGRESSIVE_TAGS))).select("word").distinct(),
        "whitelist": rows.select(F.explode("b.whitelist").alias("word")).select(X.ascii_lower(F.trim("word")).alias("word")).where("word <> ''").distinct(),
    }


def legacy(raw: DataFrame) -> DataFrame:
    """Words of four or more letters of a legacy list: language en or none, severity (default 3, within 1 to 4) of 2 at least."""
    severity = F.least(F.greatest(F.coalesce("severity", F.lit(3)), F.lit(1)), F.lit(4))
    rows = raw.where((F.col("lang").isNull() | (F.lower("lang") == "en")) & (severity >= 2))
    return rows.select(X.ascii_lower(F.trim("word")).alias("word")).where(F.length("word") >= 4).distinct()


def bad_words(*sources: DataFrame, fallback: DataFrame) -> DataFrame:
    """The union of bad-word sources, or the fallback patterns if it is empty."""
    every = None
    for s in sources:
        every = s.select("word") if every is None else every.unionByName(s.select("word"))
    if every is None or every.isEmpty():
        return fallback.select("word").distinct()
    return every.distinct()


def labelled(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Trimmed texts of label 1 of a two-column corpus."""
    return rows.where(F.col(label_col).cast("string").isin("1", "1.0")).select(F.trim(F.col(text_col).cast("string")).alias("text")).where("text is not null")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV corpus with a header; quoted texts may span lines.  A field without anything is null, "" is an empty text."""
    # "" is read by default as null, as nullValue is empty too; the one made here is no text.  By default NUL escapes a quote's
    # escape, and a quoted text that holds one loses it
    odd = {"escape": '"', "charToEscapeQuoteEscaping": '"', "nullValue": uuid.uuid4().hex}
    return spark.read.schema(schema).options(header=True, multiLine=True, **odd).csv(path)


def corpora(*sources: DataFrame) -> DataFrame:
    """All rows of several corpora, repeated ones too."""
    return reduce(DataFrame.unionByName, sources)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_split(spark: SparkSession, folder: str, splits: list[str], kind: str = "json") -> DataFrame | None:
    """The first split of a corpus that is there, else None: a source that cannot be read is left out."""
    for split in splits:
        if exists(spark, f"{folder}/{split}"):
            return spark.read.format(kind).load(f"{folder}/{split}")
    return None


def fields(rows: DataFrame, names: list[str]) -> list[Column]:
    """Those of several columns, dotted paths allowed, that a table has."""
    have = []
    for n in names:
        at: T.DataType | None = rows.schema
        for part in n.split("."):
            at = at[part].dataType if isinstance(at, T.StructType) and part in at.names else None
            if at is None:
                break
        if at is not None:
            have.append(F.col(n))
    return have


def text_value(rows: DataFrame, names: list[str]) -> Column:
    """The first of several string columns (dotted paths allowed) that is not blank, else ''."""
    have = [F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in fields(rows, names)]
    return F.coalesce(*have, F.lit(""))


def mined(raw: DataFrame, json_col: str = "value", most: int | None = None) -> DataFrame:
    """Records of mined files, one JSON text a row, with pos; records that are no list are an error.  most: of each file."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_col), "$.records", "variant"))
    listed = F.when(kind.isNotNull() & ~kind.startswith("ARRAY"), F.raise_error(F.lit("records must be a list"))).otherwise(F.from_json(json_col, MINED_SCHEMA)["records"])
    rows = raw.select(F.posexplode(listed).alias("pos", "r")).select("pos", "r.*")
    return rows.where(F.col("pos") < most) if most is not None else rows


def _messages(value, depth: int = 0) -> list[dict]:
    """role and text of the messages in a parsed container: a list, an object that holds one, or a text that holds either."""
    if isinstance(value, str) and depth < 8:
        try:
            return _messages(json.loads(value), depth + 1)
        except ValueError:
            return []
    if isinstance(value, dict) and depth < 8:
        return next((found for k in CONTAINERS if (found := _messages(value.get(k), depth + 1))), [])
    out = []
    for m in value if isinstance(value, list) else ():
        if isinstance(m, str):
            role, said = "", m
        elif isinstance(m, dict):
            role, said = next((str(m[k]) for k in ROLES if m.get(k)), ""), next((t for k in SAID if (t := _said(m.get(k)))), "")
        else:
            continue
        if said.strip():
            out.append({"role": role, "text": said.strip()})
    return out


def _said(value) -> str:
    """A message's text, which may come in parts."""
    if isinstance(value, list):
        parts = [p if isinstance(p, str) else next((p[k] for k in PARTS if p.get(k)), None) if isinstance(p, dict) else None for p in value]
        value = " ".join(p for p in parts if isinstance(p, str))
    return value if isinstance(value, str) and value.strip() else ""


#: The names that containers, speakers, texts and their parts go by.
CONTAINERS, ROW_CONTAINERS = ("conversation", "conversations", "messages", "turns"), ("conversation", "conversations", "messages", "turns", "chat", "conversation_a")
ROLES, SAID, PARTS = ("role", "speaker", "from", "author"), ("content", "text", "value", "message"), ("text", "content", "value")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))
def _parsed(rows: pa.Array) -> pa.Array:
    """A row is an object whose containers are tried in turn, or a list."""

    def one(text):
        try:
            row = json.loads(text) if text else None
        except ValueError:
            return []
        if isinstance(row, dict):
            return next((found for k in ROW_CONTAINERS if (found := _messages(row.get(k)))), [])
        return _messages(row)

    return pa.array([one(t) for t in rows.to_pylist()], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))


def conversation(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """The messages of conversations in JSON, in order, as turn, role and text beside the other columns of raw.

    A row is a list of messages or an object that holds one under a name of ROW_CONTAINERS; containers may be nested and may
    be JSON texts, which no fixed schema can say, so Python parses them.  Broken rows and blank messages give nothing."""
    rows = raw.withColumn("__m", _parsed(F.col(json_col)))
    return rows.select(*[c for c in raw.columns if c != json_col], F.posexplode("__m").alias("turn", "m")).select("*", "m.role", "m.text").drop("m")


def decision_model(raw: DataFrame, json_col: str = "value", base: lexicon.Weights = lexicon.SHIPPED) -> DataFrame:
    """review, block and weights (a map) of decision models in JSON over the base model's, beside the other columns of raw.

    Thresholds are put within 0 and 1 and swapped if block is below review; only known features count; a broken text
    changes nothing."""
    names = list(base.weights)
    schema = "reviewThreshold double, blockThreshold double, features map<string,double>"
    rows = raw.withColumn("__b", F.from_json(json_col, schema))
    inside = lambda c, default: F.when(c.isNotNull(), hashing.clamped(c, 0.0, 1.0)).otherwise(F.lit(default))
    review, block = inside(F.col("__b.reviewThreshold"), base.review), inside(F.col("__b.blockThreshold"), base.block)
    given = F.col("__b.features")
    camel = lambda n: n.split("_")[0] + "".join(p.title() for p in n.split("_")[1:])
    weights = F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(given[camel(n)], F.lit(base.weights[n])))])
    return rows.select(*[c for c in raw.columns if c != json_col], F.least(review, block).alias("review"), F.greatest(review, block).alias("block"), weights.alias("weights"))


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of whitelist files in the form candidates have; blank lines and comments are left out."""
    return lines(spark, path, comments=True).select(X.compact(X.nfkc(F.col("line"))).alias("word")).where("word <> ''").distinct()


def context_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Distinct phrases of 2 to 24 tokens of text files."""
    return lines(spark, path).select(X.context_phrase(X.nfkc(F.col("line"))).alias("phrase")).where("phrase is not null").distinct()


def literal_messages(spark: SparkSession) -> DataFrame:
    """The project's own examples of scam messages, with their category."""
    return spark.createDataFrame([(t, "nitro_scam") for t in lexicon.SCAM_EXAMPLES], "text string, category string")


def piped(rows: DataFrame, field: int, column: str = "value") -> DataFrame:
    """One field, counted from 0, of lines cut at |; lines without it give nothing."""
    parts = F.split(F.col(column), r"\|")
    return rows.where(F.size(parts) > field).select(parts[field].alias("field"))


def message_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 8) -> DataFrame:
    """Messages as they arrive in a folder of Parquet files; rows without text are dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path).where("text is not null")


def commands(messages: DataFrame, prefix: str = "/train ") -> tuple[DataFrame, DataFrame]:
    """(plain messages, texts of training commands)."""
    is_command = F.col("text").startswith(prefix)
    train = messages.where(is_command).select(F.trim(F.substring(F.col("text"), F.lit(len(prefix) + 1), F.length("text"))).alias("text")).where("text <> ''")
    return messages.where(~is_command), train
