"""Tables that grow by builds and never show half of one.

A build writes its rows to a folder of their own and the keys it covers to another; last of all it appends one row to the manifest. Readers
follow the manifest, so a build that dies on the way leaves files that nobody reads, its keys count as not built, and the next run
builds them again. A key built again (overwrite) replaces its earlier rows: each key is read from the latest build that covers it.

    root/data/<build>/   rows, in ranges of the key, so a reader of few keys skips most row groups
    root/keys/<build>/   distinct keys
    root/manifest/       one JSON row per finished build

One writer at a time per table; builds of equal version (two writers at once) are told apart by their names. The manifest has a
row per build and is the only thing the driver reads."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version long, build string, key string, n_keys long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Finished builds; none where the table does not exist yet."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _MANIFEST)


def write_build(df: DataFrame, root: str, key: str, within: Sequence[str] = ()) -> str:
    """The files of a build, not yet part of the table. `within` names columns that split a key of very many rows."""
    build, spark = uuid.uuid4().hex, df.sparkSession
    df.repartitionByRange(key, *within).sortWithinPartitions(key, *within).write.parquet(f"{root}/data/{build}")
    spark.read.parquet(f"{root}/data/{build}").select(key).distinct().write.parquet(f"{root}/keys/{build}")
    return build


def commit(spark: SparkSession, root: str, build: str, key: str) -> None:
    """Makes a build part of the table."""
    last = manifest(spark, root).agg(F.max("version")).first()[0]
    n = spark.read.parquet(f"{root}/keys/{build}").count()
    row = spark.createDataFrame([((last or 0) + 1, build, key, n)], _MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{root}/manifest")


def _keys(spark: SparkSession, root: str, done: list[str], key: str) -> DataFrame:
    """Each built key with the build it is read from."""
    held = spark.read.parquet(*[f"{root}/keys/{b}" for b in done])
    held = held.select(key, F.regexp_extract(F.col("_metadata.file_path"), "/keys/([0-9a-f]+)/", 1).alias("build"))
    order = manifest(spark, root).select("build", "version")
    return held.join(order, "build").groupBy(key).agg(F.max_by("build", F.struct("version", "build")).alias("build"))


def built(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """Keys of the table, or None where nothing has been built."""
    done = [r["build"] for r in manifest(spark, root).filter("n_keys > 0").select("build").collect()]
    return _keys(spark, root, done, key).select(key) if done else None


def read_table(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Rows of all finished builds, each key as its latest build has it."""
    done = [r["build"] for r in manifest(spark, root).orderBy("version").select("build").collect()]
    if not done:
        raise FileNotFoundError(f"no finished build in {root}")
    rows = spark.read.parquet(*[f"{root}/data/{b}" for b in done])
    if len(done) == 1:
        return rows
    tagged = rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]+)/", 1).alias("_build"))
    latest = _keys(spark, root, done, key).select(F.col(key).alias("_key"), F.col("build").alias("_of"))
    return tagged.join(latest, (F.col(key) == F.col("_key")) & (F.col("_build") == F.col("_of"))).drop("_build", "_key", "_of")


def build_missing(rows: DataFrame, root: str, key: str, within: Sequence[str] = (), overwrite: bool = False) -> DataFrame:
    """Builds the keys of `rows` that the table lacks, or all of them again with `overwrite`, and returns the table."""
    spark = rows.sparkSession
    have = None if overwrite else built(spark, root, key)
    todo = rows if have is None else rows.join(have, key, "left_anti")
    commit(spark, root, write_build(todo, root, key, within), key)
    return read_table(spark, root, key)


def merge_rows(fresh: DataFrame, root: str, key: str, row: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows of `fresh` replace rows of the table equal in `row` and join the others; returns the table.

    `key` is a column of both that names the part of the table a row lies in. Only parts that fresh rows touch are read and written
    again; all others stay in the files they are in."""
    spark = fresh.sparkSession
    have = built(spark, root, key)
    if have is not None:
        touched = fresh.select(key).distinct()
        old = read_table(spark, root, key).join(touched, key, "left_semi")
        fresh = fresh.unionByName(old.join(fresh.select(*row), list(row), "left_anti"))
    return build_missing(fresh, root, key, within, overwrite=True)
