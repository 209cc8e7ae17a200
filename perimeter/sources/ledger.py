"""Chunk files of the archive and the ledger of what has landed.

Resuming and auditing look at files, not at rows: a file that holds a header only has landed, and a chunk
whose file is absent has not, whatever days its neighbours cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land_chunks(chunks: DataFrame, rows: DataFrame, path: str, columns: Sequence[str], key: str = "chunk") -> None:
    """Writes one delimited file per row of `chunks`, below `path`/key=name, with a header and the chunk's rows if there are any.
    A file is one task's work, as a chunk covers few days."""
    header = chunks.select(F.col(key).cast("string"), F.lit(0).alias("_n"), F.lit(",".join(columns)).alias("value"))
    data = rows.select(F.col(key).cast("string"), F.lit(1).alias("_n"), F.to_csv(F.struct(*columns)).alias("value"))
    (header.unionByName(data).repartition(key).sortWithinPartitions(key, "_n", "value").select(key, "value")
     .write.mode("append").partitionBy(key).text(path))


def file_ledger(spark: SparkSession, path: str, key: str = "chunk") -> DataFrame:
    """(chunk, file, bytes, n_lines): every file below `path`. Only names and sizes are listed for the first three; lines are counted by
    Spark's text reader. A file of no bytes, which a writer leaves that died before the header, has not landed and is not listed."""
    file = F.col("_metadata.file_path").alias("file")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(file, F.col("length").alias("bytes"))
    lines = (spark.read.option("recursiveFileLookup", True).text(path).select(file).groupBy("file").agg(F.count("*").alias("n_lines")))
    name = F.regexp_extract("file", f"/{key}=([^/]+)/[^/]*$", 1)
    return listed.join(lines, "file", "left").select(name.alias(key), "file", "bytes", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))
