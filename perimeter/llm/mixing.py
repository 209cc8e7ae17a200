"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

The documents of each source are hashed into blocks of about equal size. A source's target (in words) is
met by whole permutations of its blocks and, in the last one, by as many blocks as are needed. Of
the last block documents are drawn in hash order, and those that do not fit what is left are passed over; at the end the
smallest that was left out is drawn if that brings the source nearer to its target. So a source ends within half of
the smallest document left out of its last block. A document longer than a quarter of a block is a block of its own (equal rows are one
together): if it does not fit it is passed over, and the next blocks follow. These block quotas are exact. They are then split among output shards by a binary tree: a node holds a quota per
source and gives its left half a multivariate hypergeometric draw from it, so each shard gets a fixed
number of blocks in random composition. A shard's blocks are the next ones of each source's permuted
list, so shards are disjoint, and rows are shuffled inside a shard by hash.

Only sums per source and per block pass through the driver: at most MAX_SOURCES and 5 * MAX_BLOCKS numbers (four long
documents for each block at most).
Everything random comes from hashes and seeded generators over sorted input, so reruns agree.

Cases: a null text has size 0 and is drawn with its block. A null source is a source, last in order.
Equal rows fall into one block and are drawn each on its own. A source without words has target 0. Other columns are kept
as they are; an empty table gives an empty mix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimeter.storage import materialize

WEIGHTS, MOST = (5, 2, 1), 3
#: Bounds of what the driver plans with, least words in a block, and blocks in an output shard.
MAX_SOURCES, MAX_BLOCKS, BLOCK_WORDS, SHARD_BLOCKS = 1_000_000, 65_536, 20_000, 64
#: A document of more than this part of a block's words is a block of its own.
LONG = 4
#: Most rows of a plan that are broadcast (some 10 MB); a larger one is joined by shuffle.
MAX_BROADCAST = 150_000


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above `most` times its size; what is cut off is shared again."""
    out, total, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.remove(i)
    return out


def split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas per shard (rows) that add up to `quota`: a binary tree of multivariate hypergeometric draws."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    some = rng.multivariate_hypergeometric(quota, int(quota.sum()) * left // shards, method="marginals")
    return np.vstack((split(some, left, rng), split(quota - some, shards - left, rng)))


def _block(seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    return F.when(LONG * F.col("size") > F.col("block_words"), F.col("blocks") + F.pmod(h, F.lit(1 << 40))).otherwise(F.pmod(h, F.col("blocks"))).cast("long")


def _choose(blocks: dict[int, tuple[int, int, int]], want: float, most: int, seed: list[int], long: int) -> list[tuple[int, int, int | None]]:
    """(block, epoch, words to draw of it or None for all) from words, least and largest size per block; from number `long` on, blocks are long documents."""
    mine: list[tuple[int, int, int | None]] = []
    numbers, left, passed = np.array(sorted(blocks)), want, []
    for epoch in range(most):
        for b in np.random.default_rng([*seed, epoch]).permutation(numbers).tolist():
            if left <= 0:
                return mine
            words, least, largest = blocks[b]
            if words <= left:
                mine.append((b, epoch, None))
                left -= words
            elif b >= long and least == largest:
                # A long document, or equal rows of it: as many as fit.
                if many := int(left // least):
                    mine.append((b, epoch, many * least))
                    left -= many * least
                if many == 0 or words > many * least:
                    passed.append((least, epoch, b))
            else:
                mine.append((b, epoch, round(left)))
                return mine
    # Nothing else is left to draw: one long document more, if that is nearer.
    if passed and min(passed)[0] < 2 * left:
        least, epoch, b = min(passed)
        at = next((n for n, d in enumerate(mine) if d[:2] == (b, epoch)), None)
        if at is None:
            mine.append((b, epoch, least))
        else:
            mine[at] = (b, epoch, mine[at][2] + least)
    return mine


def _fill(table: pa.Table) -> pa.Table:
    """How many of the n equal rows (doc_id, size) of a block are drawn of it, in the order of rank."""
    order = np.lexsort((table["size"].to_numpy(), table["rank"].to_numpy()))
    size, n, left = table["size"].to_numpy()[order], table["n"].to_numpy()[order], table["take"][0].as_py()
    got = np.zeros(len(order), np.int64)
    for i in range(len(order)):
        got[i] = n[i] if size[i] == 0 else min(n[i], left // size[i])
        left -= int(got[i] * size[i])
    out = np.flatnonzero(got < n)
    if len(out):
        i = out[np.argmin(size[out])]
        got[i] += size[i] < 2 * left
    return table.take(order).select(["source", "block", "doc_id", "size", "epoch"]).append_column("many", pa.array(got))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per source its size, target and number of blocks; per block that is drawn its draws."""
    spark = sized.sparkSession
    by = sized.groupBy("source").agg(F.sum("size").alias("size"))
    if by.count() > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources; group them first")
    rows = sorted(((r["source"], int(r["size"])) for r in by.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    total = sum(n for _, n in rows)
    per_block = max(BLOCK_WORDS, -(-total // MAX_BLOCKS))
    want = targets([n for _, n in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    counts = [max(1, -(-n // per_block)) for _, n in rows]
    sources = spark.createDataFrame([(s, n, t, b, per_block) for (s, n), t, b in zip(rows, want, counts)],
                                    "source string, source_size long, target double, blocks int, block_words long")
    filled = (with_source(sized, sources).withColumn("block", _block(seed)).groupBy("source", "block")
              .agg(F.sum("size").alias("size"), F.min("size").alias("least"), F.max("size").alias("most")).collect())
    held: dict[str | None, dict[int, tuple[int, int, int]]] = {s: {} for s, _ in rows}
    for r in filled:
        held[r["source"]][r["block"]] = int(r["size"]), int(r["least"] or 0), int(r["most"] or 0)
    drawn: list[list[tuple[int, int, int | None]]] = []
    for i, (s, n) in enumerate(rows):
        mine = _choose(held[s], want[i], most, [seed, i], counts[i]) if n else []
        order = np.random.default_rng([seed, i, most]).permutation(len(mine)).tolist()
        drawn.append([mine[j] for j in order])
    quota = np.array([len(d) for d in drawn], np.int64)
    shards = max(1, -(-int(quota.sum()) // SHARD_BLOCKS))
    leaves = split(quota, shards, np.random.default_rng([seed, len(rows)])) if len(rows) else np.zeros((1, 0), np.int64)
    ends = np.cumsum(leaves, axis=0)
    draws: dict[tuple[str | None, int], list] = {}
    for i, (s, _) in enumerate(rows):
        shard_of = np.searchsorted(ends[:, i], np.arange(len(drawn[i])), side="right").tolist()
        for (b, epoch, take), shard in zip(drawn[i], shard_of):
            draws.setdefault((s, b), []).append((epoch, shard, take))
    table = spark.createDataFrame([(s, b, sorted(d, key=lambda x: x[0])) for (s, b), d in draws.items()],
                                  "source string, block long, draws array<struct<epoch:int,shard:int,take:long>>")
    return _small(sources, len(rows)), _small(table, len(draws))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def with_source(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """`sized` with source_size, target, blocks and block_words. The plan is broadcast or, if large, shuffled; AQE splits a hot source."""
    right = sources.withColumnRenamed("source", "_source")
    return sized.join(right, sized["source"].eqNullSafe(right["_source"])).drop("_source")


def drawn(sized: DataFrame, sources: DataFrame, table: DataFrame, seed: int = 0) -> DataFrame:
    """Every row of `sized` (doc_id, source, size and any more) with source_size, target and `draws`, its (epoch, shard) pairs."""
    right = table.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "draws")
    rows = with_source(sized, sources).withColumn("block", _block(seed))
    rows = rows.join(right, rows["source"].eqNullSafe(right["_source"]) & (rows["block"] == right["_block"]), "left").drop("_source", "_block")
    rows = rows.withColumn("_part", F.coalesce(F.exists("draws", lambda d: d["take"].isNotNull()), F.lit(False)))
    # At most one block per source, and long documents, are drawn in part; only their sizes are put in order.
    part = rows.filter("_part")
    asked = (part.groupBy("source", "block", "doc_id", "size").agg(F.count("*").alias("n"), F.first("draws").alias("d"))
             .select("source", "block", "doc_id", "size", "n", F.explode("d").alias("d")).filter("d.take IS NOT NULL")
             .select("source", "block", "doc_id", "size", "n", "d.epoch", "d.take", F.xxhash64(F.lit(seed + 1), "doc_id", "size").alias("rank")))
    got = asked.groupBy("source", "block", "epoch").applyInArrow(_fill, "source string, block long, doc_id long, size long, epoch int, many long")
    got = (got.groupBy("source", "block", "doc_id", "size").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "many"))).alias("_many"))
           .select(*[F.col(c).alias(f"_{c}") for c in ("source", "block", "doc_id", "size")], "_many"))
    nth = F.row_number().over(Window.partitionBy("source", "block", "doc_id", "size").orderBy("source"))
    keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("source", "block", "doc_id", "size")]
    cut = (part.withColumn("_nth", nth).join(got, keys[0] & keys[1] & keys[2] & keys[3], "left")
           .withColumn("draws", F.filter("draws", lambda d: d["take"].isNull() | (F.col("_nth") <= F.get(F.map_values("_many"), F.array_position(F.map_keys("_many"), d["epoch"]).cast("int") - 1))))
           .drop("_nth", "_many", "_source", "_block", "_doc_id", "_size"))
    pairs = F.transform("draws", lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard")))
    none = F.array().cast("array<struct<epoch:int,shard:int>>")
    return rows.filter("NOT _part").unionByName(cut).withColumn("draws", F.coalesce(pairs, none)).drop("_part", "block", "blocks", "block_words")


def mixed(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target and draws of every row of `docs`."""
    sized = materialize(docs.select("doc_id", "source", size.alias("size")))
    return drawn(sized, *plan(sized, weights, most, seed), seed)


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mix itself: a row of `docs` per draw, with epoch and shard, in shuffled order inside each shard."""
    inner = [c for c in docs.columns if c in ("doc_id", "source")]
    more = F.struct(*[c for c in docs.columns if c not in inner] or [F.lit(0).alias("_")]).alias("_more")
    sized = docs.select(*inner, size.alias("size"), more)
    rows = drawn(sized, *plan(materialize(sized.select("doc_id", "source", "size")), weights, most, seed), seed)
    names = [F.col(c) if c in inner else F.col(f"_more.{c}").alias(c) for c in docs.columns]
    out = rows.select("*", F.explode("draws").alias("_d")).select(*names, F.col("_d.epoch").alias("_epoch"), F.col("_d.shard").alias("_shard"))
    return out.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64(F.lit(seed + 2), "_epoch", "doc_id"))
