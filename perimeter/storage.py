"""Durable intermediate tables.

Every barrier is a parquet table below the checkpoint folder the session names
(`spark.checkpoint.dir`), so lost executors cost a re-read, never a recomputed lineage, and
readers of a stage keep column pruning, filter pushdown and true size statistics.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGES: dict[tuple[str, str, str], str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the session. Where none is set on a single machine, one below the warehouse
    that goes when Python ends; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/barriers-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named.removeprefix("file:"), ignore_errors=True)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once and continue from the written table (cuts the lineage)."""
    path = f"{checkpoint_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that have ended. Spark deletes them once the driver's collector finds their plans
    unused, which on a large idle heap is long after the disk has filled."""
    spark.sparkContext._jvm.System.gc()


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows that are about to be exploded over as many tasks as a shuffle has. They are few and small, so adaptive execution (or
    one small file) would leave them to one task, which then makes all that they stand for."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stage(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A named barrier shared by all queries of one application over the same input."""
    digest = hashlib.md5(scope.encode()).hexdigest()[:12]
    key = (spark.sparkContext.applicationId, digest, name)
    if key not in _STAGES:
        path = f"{checkpoint_root(spark)}/stages/{digest}/{name}-{uuid.uuid4().hex[:8]}"
        build().write.parquet(path)
        _STAGES[key] = path
        release(spark)
    return spark.read.parquet(_STAGES[key])


def forget_stages() -> None:
    """Drop the stage registry, so that the next query starts cold (used by the benchmark)."""
    _STAGES.clear()
