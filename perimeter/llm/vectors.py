"""Approximate nearest neighbours from balanced posting lists.

A bounded sample is clustered into centroids. Every vector is posted to its nearest centroid and also to
others whose distance is within `BOUNDARY` of the nearest's, up to `COPIES` lists, so vectors on a border are found from
either side. Lists are cut into blocks of at most `BLOCK` vectors, and queries into blocks as well: a
hot list is many small tasks. Centroids are searched by a graph in memory: each is tied to its
nearest centroids, and a search walks the graph by best-first steps from fixed entry points. A
query reads one list in `READ`, nearest first and `PROBES` at least, so the share that is read does not fall as the
table grows. Of these, lists further than `PRUNE` times a distance are left out: not that of the nearest centroid, which is
near 0 in a tight cluster, but the distance up to which lists hold as many vectors as are wanted, each counted in its nearest
list. A query that still finds fewer than wanted is compared with all rows.

Bounds: the sample has `SAMPLE` vectors at most and there are `MAX_LISTS` centroids at most, so the broadcast
index is a few MB. For inner products, vectors get one more coordinate that makes all lengths equal
(queries a zero), so that the nearest by distance is the one of largest product; its scale comes from all vectors.
Scores are exact products of the original vectors in double precision.

Cases: vectors that are null, zero or hold a null or non-finite component take no part, as query or candidate. Vectors
of a dimension other than the most frequent's in the sample take no part either. Ties go to the smaller id. A query never finds its own id. Rows equal in
id and vector count once. Fewer candidates than wanted give fewer rows; empty tables give none."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perimeter.storage import materialize

SAMPLE, MAX_LISTS, ROUNDS, SEED = 32_768, 4096, 8, 7
COPIES, BOUNDARY, PROBES, READ, PRUNE, BLOCK, DEGREE, BEAM, POST_BEAM = 4, 1.15, 48, 8, 1.6, 2048, 24, 96, 24


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray      # neighbours of each centroid
    entries: np.ndarray    # where searches begin
    length: float          # common length of the lifted vectors

    @staticmethod
    def fit(sample: np.ndarray, lists: int, length: float) -> Index:
        rng = np.random.default_rng(SEED)
        x = lift(sample, length)
        c = x[np.sort(rng.permutation(len(x))[:lists])]
        for _ in range(ROUNDS):
            near = np.concatenate([np.argmin(_squares(x[i:i + 4096], c), axis=1) for i in range(0, len(x), 4096)])
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            # A list without vectors takes over half of the longest one.
            for e in np.flatnonzero(n == 0):
                big = int(np.argmax(n))
                own = np.flatnonzero(near == big)
                half = own[len(own) // 2:]
                if len(own) < 2:
                    break
                near[half] = e
                n[big], n[e] = len(own) - len(half), len(half)
                sums[e] = x[half].sum(axis=0)
                sums[big] -= sums[e]
            c = np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], c)
        c = np.unique(c, axis=0)
        k = min(DEGREE, len(c) - 1)
        graph = np.stack([np.argsort(_squares(row[None], c)[0], kind="stable")[1:k + 1] for row in c]) if k else np.zeros((len(c), 0), np.int64)
        return Index(c, graph, np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int), length)

    def search(self, q: np.ndarray, most: int, beam: int) -> list[tuple[float, int]]:
        """(distance, centroid) of the nearest found, nearest first: best-first steps over the graph."""
        d = np.sqrt(np.maximum(((self.centroids[self.entries] - q) ** 2).sum(axis=1), 0))
        seen = np.zeros(len(self.centroids), bool)
        seen[self.entries] = True
        todo = list(zip(d.tolist(), self.entries.tolist()))
        best = [(-x, i) for x, i in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        width = max(most, beam)
        while todo:
            x, i = heapq.heappop(todo)
            if len(best) >= width and x > -best[0][0]:
                break
            new = self.graph[i][~seen[self.graph[i]]]
            seen[new] = True
            for y, j in zip(np.sqrt(((self.centroids[new] - q) ** 2).sum(axis=1)).tolist(), new.tolist()):
                if len(best) < width or y < -best[0][0]:
                    heapq.heappush(todo, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-x, i) for x, i in best)[:most]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None]


def lift(x: np.ndarray, length: float) -> np.ndarray:
    """One more coordinate, so that every vector has the same length."""
    return np.hstack((x, np.sqrt(np.maximum(length ** 2 - (x * x).sum(axis=1), 0))[:, None]))


def _lists(shared, held: np.ndarray | None = None, k: int = 0):
    """Lists of each vector: those it is posted to or, where `held` has the vectors nearest to each list, those a query for k reads."""
    query = held is not None
    ratio, beam = (PRUNE, BEAM) if query else (BOUNDARY, POST_BEAM)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index: Index = shared.value
        most = max(PROBES, ceil(len(index.centroids) / READ)) if query else COPIES
        for batch in batches:
            x = np.stack([np.asarray(v, np.float64) for v in batch]) if len(batch) else np.zeros((0, index.centroids.shape[1] - 1))
            x = np.hstack((x * (index.length / np.sqrt((x * x).sum(axis=1)))[:, None], np.zeros((len(x), 1)))) if query else lift(x, index.length)
            out = []
            for v in x:
                found = index.search(v, most, beam)
                # Up to here lists hold k vectors besides the query itself.
                full = min(int(np.searchsorted(np.cumsum(held[[i for _, i in found]]), k + 1)), len(found) - 1) if query else 0
                out.append([i for d, i in found if d <= ratio * found[full][0] + 1e-12])
            yield pd.Series(out)
    return run


def _scorer(k: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        # left: a block of vectors; right: a block of queries that read its list
        ids, qids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        if not len(ids) or not len(qids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dense = lambda t, n: t["v"].combine_chunks().flatten().to_numpy().reshape(n, -1).astype(np.float64)
        x, q = dense(left, len(ids)), dense(right, len(qids))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        s = np.stack([(x * row).sum(axis=1) for row in q])  # the same sum for a pair in any block
        s[ids[None] == qids[:, None]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        got = np.take_along_axis(s, top, axis=1)
        keep = np.isfinite(got)
        return pa.table({"query_id": np.repeat(qids, top.shape[1])[keep.reshape(-1)], "vec_id": ids[top][keep], "score": got[keep]})
    return score


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows (vec_id, embedding) found nearest to each query."""
    spark = rows.sparkSession
    v = F.col("embedding")
    finite = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))), F.lit(False)) & F.coalesce(
        F.exists(v, lambda c: c != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    clean = lambda df: df.select("vec_id", "embedding").filter(finite)
    square = F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    facts = clean(rows).groupBy(F.size(v).alias("n")).agg(F.count("*").alias("rows"), F.max(square).alias("most")).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts:
        return spark.createDataFrame([], schema)
    n, total, most = max(((r["n"], r["rows"], r["most"]) for r in facts), key=lambda r: (r[1], r[0]))
    keep = F.size(v) == n
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < ceil(min(1.0, 1.2 * SAMPLE / total) * 1_000_003)
    sample = clean(rows).filter(keep & share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    lists = int(min(MAX_LISTS, max(1, sqrt(total) * 2), max(1, len(sample) // 8)))
    index = Index.fit(np.array([r["embedding"] for r in sample], np.float64), lists, sqrt(most)) if sample else None
    if index is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index)
    posted = materialize(clean(rows).filter(keep).distinct().select("vec_id", v.alias("v"), _lists(shared)(v).alias("lists"))
                         .select("vec_id", "v", F.posexplode("lists").alias("nth", "list")))
    nearest_to = posted.filter("nth = 0")
    held = np.zeros(len(index.centroids), np.int64)
    for r in nearest_to.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    asked = materialize(clean(queries).filter(keep).distinct().select(F.col("vec_id").alias("query_id"), v.alias("v"), _lists(shared, held, k)(v).alias("lists")))
    best = materialize(_best(posted, asked.select("query_id", "v", F.explode("lists").alias("list")), k))
    # Queries that found fewer than wanted, unless no more candidates exist, are compared with all rows.
    enough = best.filter(F.col("rank") == k).select("query_id")
    short = materialize(asked.join(enough, "query_id", "left_anti").select("query_id", "v", F.lit(0).alias("list")))
    if short.isEmpty():
        return best
    exact = _best(nearest_to.select("vec_id", "v", F.lit(0).alias("list")), short, k)
    return best.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(exact)


def _best(posted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of the pairs of posted (vec_id, v, list) and asked (query_id, v, list) that share a list."""
    # How many blocks each list has, on both sides: at most MAX_LISTS rows.
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cut = blocks(posted, "nb").join(blocks(asked, "nq"), "list")
    mine = lambda key, many: F.pmod(F.xxhash64(key), F.col(many)).cast("int")
    every = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    left = posted.join(F.broadcast(cut), "list").select("vec_id", "v", "list", mine("vec_id", "nb").alias("b"), F.explode(every("nq")).alias("q"))
    right = asked.join(F.broadcast(cut), "list").select("query_id", "v", "list", F.explode(every("nb")).alias("b"), mine("query_id", "nq").alias("q"))
    keys = ("list", "b", "q")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scorer(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
