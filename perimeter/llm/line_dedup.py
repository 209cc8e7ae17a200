"""Line dedup by overlapping windows of three lines (DataFrame functions only).

Each window of three consecutive lines is hashed to 128 bits. A window found at several places keeps
its first occurrence, in order of document and line; the lines of every later one are removed, and
overlapping windows merge because lines are removed by position. The first place of any line in the
corpus is never removed, so every distinct line stays at least once.

Skew: windows combine per task before they are counted; the join back is one row per repeated window
against the windows, whose hot keys are split by adaptive execution.

Cases: a null text stays null and has no lines. Texts of fewer than three lines have no window and
stay. An empty text has one empty line. Rows equal in doc_id and text are one document that is counted
once, and each of its rows gets the same result. Null ids come first in order. All other columns are
kept as they are; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimeter.storage import materialize

WINDOW = 3


def covered_lines(docs: DataFrame) -> DataFrame:
    """_id, _text (hash of the text) and the sorted line positions to remove, one row per document that loses lines."""
    lines, at = F.col("_lines"), lambda i, d: F.get(F.col("_lines"), i + d)
    starts = F.sequence(F.lit(0), F.size(lines) - WINDOW)
    windows = (docs.filter("text IS NOT NULL")
               .select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.split("text", "\n").alias("_lines"))
               .filter(F.size(lines) >= WINDOW)
               .select("_id", "_text", F.explode(F.transform(starts, lambda i: F.struct(
                   i.alias("at"), F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).alias("a"),
                   F.xxhash64(at(i, 2), at(i, 1), at(i, 0)).alias("b")))).alias("w"))
               .select("_id", "_text", "w.*"))
    place = F.struct("_id", "_text", "at")
    repeated = (windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .filter("first < last").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first"))
    later = (windows.join(repeated, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
             .filter(place > F.col("first")).select("_id", "_text", "at"))
    hit = later.groupBy("_id", "_text").agg(F.collect_set("at").alias("at"))
    return hit.select("_id", "_text", F.array_sort(F.array_distinct(F.flatten(F.transform(
        "at", lambda i: F.sequence(i, i + (WINDOW - 1)))))).alias("covered"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with the text less its removed lines, and the columns n_lines and removed_lines (positions from 0)."""
    kept = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    gone = covered_lines(docs)
    rows = docs.select(*kept)
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(rows["text"]) == gone["_text"]), "left")
    lines, covered = F.col("_lines"), F.col("covered")
    out = joined.withColumn("_lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(covered.isNull(), F.col("text")).otherwise(rest)
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in kept],
                      F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                      F.coalesce(covered, F.array().cast("array<int>")).alias("removed_lines"))
