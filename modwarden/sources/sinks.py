"""Sinks: verdict and vector tables, summaries, sorted word files, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def create_if_missing(rows: DataFrame, path: str) -> None:
    rows.write.mode("ignore").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def sorted_lines(words: DataFrame, path: str, column: str = "word") -> None:
    """Distinct lines in order, range-partitioned, so the part files in order are the whole."""
    words.select(F.col(column).alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header that scans.csv reads as they were: white space at the ends of a field stays."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def source_summary(mined: DataFrame) -> DataFrame:
    """source and n of mined records."""
    return mined.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def mined_file(mined: DataFrame) -> DataFrame:
    """One JSON text with total_contexts, sources (a count each) and records in the order of (source, doc_id).

    The records are one array of one row: such a file is for a capped sample (see mining.contexts), not for a corpus, which
    json_lines() writes."""
    counts = source_summary(mined).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_contexts"))
    record = F.struct("source", "toxicity_score", "profane_terms", "context")
    records = mined.agg(F.array_sort(F.collect_list(F.struct("source", "doc_id", record.alias("r")))).alias("all")).select(F.transform("all", lambda x: x["r"]).alias("records"))
    return counts.crossJoin(records).select(F.to_json(F.struct("total_contexts", "sources", "records")).alias("value"))


def report(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Lines of several short one-column tables, each in order under its heading: part, line, value.  A report is numbered
    as one, so it is for the rows of a top list."""
    out = None
    for i, (heading, rows) in enumerate(parts):
        body = rows.select(F.col(rows.columns[0]).cast("string").alias("value"))
        numbered = body.select(F.lit(i).alias("part"), F.row_number().over(Window.orderBy("value")).alias("line"), "value")
        head = rows.sparkSession.range(1).select(F.lit(i).alias("part"), F.lit(0).alias("line"), F.lit(heading).alias("value"))
        out = head.unionByName(numbered) if out is None else out.unionByName(head).unionByName(numbered)
    return out
