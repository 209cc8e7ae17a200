"""Near-duplicates by similarity of shingle sets: SimHash candidates from BK-trees, exact Jaccard checks.

Texts are sets of shingles of `WIDTH` words; equal sets collapse first. A set has `PRINTS` independent fingerprints.
Sets at Jaccard 0.8 differ in 9.7 of 64 bits on average, so no cut of one fingerprint finds them: each is cut into
`BANDS` bands of 16 bits, sets that agree in one are a shard, and a BK-tree per shard links those within `RADIUS`
bits of the same fingerprint. A pair at exactly 0.8 is found with probability 0.98 or so (binomial estimate), one at
0.85 with 0.999. Shards that a sample shows to be larger than a tree are cut into trees and blocks, as in `simhash`.

Links of candidates form loose components. Inside each, sets are compared by exact Jaccard similarity in blocks of at
most `BLOCK` (all pairs of blocks), and a spanning forest of the pairs that reach `LEAST` makes the components. So no
pair below the threshold links, and pairs are never listed.

Cases: texts without words are equal sets. Fewer words than a shingle's are one shingle. A null id names a component
only if it has no other. Repeated rows share a set; an empty table gives none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.llm.simhash import TASK, TREE, _forest, _majority, _shingles, bk_forest, bk_search
from perimeter.operators.links import connected_components
from perimeter.storage import materialize

WIDTH, LEAST = 5, 0.8
PRINTS, BANDS, RADIUS, BLOCK = 16, 4, 10, 512
#: One in so many sets is looked at to find large shards, and most rows of a side that is broadcast.
SHARE, MAX_BROADCAST = 16, 150_000


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(np.array(_shingles(text, width), np.uint64))


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


def _scatter(x: np.ndarray, seed: int) -> np.ndarray:
    """Independent hashes from hashes (splitmix64 of a stream per seed)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(text: Column) -> Column:
    """key of the shingle set and its fingerprints, as signed longs."""
    @F.pandas_udf("key long, prints array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            keys, prints, parts, held = [], [np.zeros((0, PRINTS), np.uint64)], [], 0
            for i, t in enumerate(texts):
                parts.append(shingle_set(t))
                keys.append(_key(parts[-1]))
                held += len(parts[-1])
                if held > 1_000_000 or i + 1 == len(texts):
                    flat, n = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
                    prints.append(np.stack([_majority(_scatter(flat, s), n) for s in range(PRINTS)], axis=1))
                    parts, held = [], 0
            yield pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "prints": list(np.concatenate(prints).view(np.int64))})
    return run(text.cast("binary"))


def _link(table: pa.Table) -> pa.Table:
    """Spanning links between sets of a shard within RADIUS bits."""
    key, fp, shard = (table[c].to_numpy() for c in ("key", "fp", "shard"))
    tree, block = table["tree"].to_numpy(), table["block"].to_numpy()
    names, vertex = np.unique(key, return_inverse=True)
    # Equal fingerprints of a shard are one node; their sets are linked along.
    order = np.lexsort((fp, shard))
    fp, shard, vertex, tree, block = fp[order].view(np.uint64), shard[order], vertex[order], tree[order], block[order]
    new = np.concatenate(([True], (fp[1:] != fp[:-1]) | (shard[1:] != shard[:-1])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    low = _forest(len(names), vertex, vertex[head], np.arange(len(names)))
    first = np.flatnonzero(new)
    trees, blocks = np.logical_or.reduceat(tree, first), np.logical_or.reduceat(block, first)
    node, ask = first[trees], first[blocks]
    held, root = np.unique(shard[node], return_inverse=True)
    if len(node):
        heads, child = bk_forest(fp[node], root)
        at = np.searchsorted(held, shard[ask])
        ok = held[np.minimum(at, len(held) - 1)] == shard[ask]
        ask, at = ask[ok], at[ok]
        for q, n in bk_search(fp[node], child, fp[ask], heads[at], RADIUS):
            low = _forest(len(names), vertex[ask[q]], vertex[node[n]], low)
    hit = low != np.arange(len(names))
    return pa.table({"a": names[hit], "b": names[low[hit]]})


def _blocks(many: str, mine: str) -> Column:
    """Pairs (t, u), t <= u < many, one of which is `mine`."""
    return F.when(F.col(many) == 1, F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("u")))).otherwise(F.array_distinct(F.concat(
        F.transform(F.sequence(F.col(mine), F.col(many) - 1), lambda u: F.struct(F.col(mine).alias("t"), u.alias("u"))),
        F.transform(F.sequence(F.lit(0), F.col(mine)), lambda t: F.struct(t.alias("t"), F.col(mine).alias("u"))))))


def candidates(sets: DataFrame) -> DataFrame:
    """Spanning links (a, b) between the keys of `sets` (key, prints) that may be near."""
    dealt = sets.select("key", F.posexplode("prints").alias("s", "fp")).select("key", "fp", F.explode(F.array(*[
        F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) + (F.col("s") * BANDS + i) * 65_536 for i in range(BANDS)])).alias("shard"))
    total = sets.count() * PRINTS * BANDS
    parts = max(1, -(-total // TASK))
    some = dealt.filter(F.pmod(F.xxhash64("key"), F.lit(SHARE)) == 0).groupBy("shard").agg((F.count("*") * SHARE).alias("n"))
    large = materialize(some.filter(F.col("n") > TREE).select("shard", F.ceil(F.col("n") / TREE).cast("int").alias("_cuts")))
    rows = dealt.join(F.broadcast(large), "shard", "left").withColumn("cuts", F.coalesce("_cuts", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    placed = rows.withColumn("p", F.explode(_blocks("cuts", "mine"))).select(
        "key", "fp", "shard", (F.col("p.t") == F.col("mine")).alias("tree"), (F.col("p.u") == F.col("mine")).alias("block"),
        F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("shard"), F.lit(parts))).otherwise(F.xxhash64("shard", "p.t", "p.u")).alias("task"))
    return placed.groupBy("task").applyInArrow(_link, "a long, b long").distinct()


def similar(sets: list[np.ndarray], block: np.ndarray) -> np.ndarray:
    """Least number reachable from each set by pairs of Jaccard similarity LEAST and more. Where there are two blocks, only pairs between them count."""
    low, size = np.arange(len(sets)), np.array([len(s) for s in sets], np.int64)
    flat, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), size)
    ends, marked = np.cumsum(size), np.zeros(len(owner) + 1, bool)
    two = len(np.unique(block)) > 1
    for i in range(len(sets)):
        other = low != low[i]
        if two:
            other &= block != block[i]
        if not other.any():
            continue
        own = flat[ends[i] - size[i]: ends[i]]
        marked[own] = True
        both = np.bincount(owner[marked[flat]], minlength=len(sets))
        marked[own] = False
        near = np.flatnonzero(other & (10 * both >= round(10 * LEAST) * (size[i] + size - both)))
        low = _forest(len(sets), np.full(len(near), i), near, low)
    return low


def _check(table: pa.Table) -> pa.Table:
    key, at = np.unique(table["key"].to_numpy(), return_index=True)
    texts = table["text"].to_pylist()
    low = similar([shingle_set(texts[i]) for i in at], table["mine"].to_numpy()[at])
    hit = low != np.arange(len(key))
    return pa.table({"a": key[hit], "b": key[low[hit]]})


def _components(links: DataFrame) -> DataFrame:
    """key and component of all that is linked."""
    ends = links.select(F.explode(F.array("a", "b")).alias("box")).distinct()
    return materialize(connected_components(ends, links).select(F.col("box").alias("key"), F.col("component").alias("root")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def near_sets(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (least id reachable) of every row of `docs` (doc_id, text)."""
    marked = materialize(docs.select(F.col("doc_id").alias("_doc"), signatures(F.col("text")).alias("s")).select("_doc", "s.*"))
    sets = materialize(marked.groupBy("key").agg(F.min("_doc").alias("low"), F.first("prints").alias("prints")))
    named = marked.select("_doc", "key").join(sets.select("key", "low"), "key")
    plain = named.select(F.col("_doc").alias("doc_id"), F.col("low").alias("component_id"))
    loose = materialize(candidates(sets.select("key", "prints")))
    if loose.isEmpty():
        return plain
    found = _components(loose)
    many = materialize(found.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many")))
    asked = materialize(found.join(many, "root").join(sets.select("key", "low"), "key")
                        .select("key", "root", "many", "low", F.pmod(F.xxhash64("key"), F.col("many")).cast("int").alias("mine")))
    # A set's text is that of its least id; rows that share the id have other sets and are told apart by the key.
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(_small(asked), F.col("doc_id").eqNullSafe(F.col("low")))
    texts = texts.filter(signatures_key(F.col("text")) == F.col("key")).withColumn("p", F.explode(_blocks("many", "mine")))
    links = materialize(texts.select("key", "text", "mine", "root", "p.t", "p.u").groupBy("root", "t", "u").applyInArrow(_check, "a long, b long"))
    if links.isEmpty():
        return plain
    of = _components(links)
    least = of.join(sets.select("key", "low"), "key").groupBy("root").agg(F.min("low").alias("least"))
    of = materialize(of.join(least, "root").select("key", "least"))
    return named.join(_small(of), "key", "left").select(F.col("_doc").alias("doc_id"), F.coalesce("least", "low").alias("component_id"))


def signatures_key(text: Column) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([_key(shingle_set(t)) for t in texts], np.uint64).view(np.int64))
    return run(text)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that name their component; of rows that share such an id, the least row."""
    names = near_sets(docs.select("doc_id", "text")).withColumn("own", F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = materialize(names.groupBy("doc_id").agg(F.max("own").alias("own"), F.sum(F.col("own").cast("int")).alias("n")))
    gone = ids.filter("NOT own").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(_small(gone), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
    if ids.filter("n > 1").isEmpty():
        return kept
    return kept.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
