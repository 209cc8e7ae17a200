"""SimHash near-duplicates, searched in BK-trees.

Fingerprints are 64 bits wide and linked if at most `radius` bits differ. Equal fingerprints collapse
first, whatever their number. Two that differ in at most r bits agree in one of r + 1 bands of bits, so
each band value is a shard of candidates, and every shard has a BK-tree: a child hangs under its parent
at the integer distance between them, and a search that stands d from a node follows only the edges d -
r to d + r. The trees of many shards grow and are searched together, level by level, in numpy. A tree
never holds more than `TREE` fingerprints: a larger shard is cut into trees of that size, and each tree
is sent to every block of the shard's fingerprints. So trees travel by shuffle: broadcasting all from
the driver would have it hold every fingerprint. A task returns a spanning forest of what it found, not
the pairs; the forests are joined into components by contraction in written rounds.

Cases: a null or wordless text has fingerprint zero and is linked like any other. One or two words are
one shingle. Repeated rows, ids or texts share a fingerprint; a null id never names a component unless
it has no other (then its name is null). Other columns stay as they are; an empty table gives none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.operators.links import connected_components
from perimeter.storage import materialize

WIDTH = 64
#: Fingerprints in a tree or in a block of searches, and distinct fingerprints dealt to one task.
TREE, TASK = 16_384, 16_384
_LANES = np.uint64(0x0001000100010001)


def _shingles(text: bytes | None, width: int) -> list[int]:
    w = (text or b"").lower().split()  # on bytes, both know ASCII only
    if len(w) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else []
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(w) - width + 1].tolist(), ends[width - 1:].tolist())]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint per document: bits set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # Four 16-bit counters share a word, so sums run over at most 65,535 hashes at a time.
    n = counts[full]
    pieces = -(-n // 65_535)
    first = np.cumsum(n) - n
    cuts = np.concatenate([s + 65_535 * np.arange(p) for s, p in zip(first, pieces)])
    of = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    for k in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        for lane in range(4):
            part = ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            ones = np.add.reduceat(part, of)
            out[full] |= (2 * ones > n).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def fingerprint(text: Column, width: int = 3) -> Column:
    """Fingerprint of a text column as a signed long."""
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, parts, held = [np.zeros(0, np.uint64)], [], 0
            for i, t in enumerate(texts):
                parts.append(np.array(_shingles(t, width), np.uint64))
                held += len(parts[-1])
                if held > 2_000_000 or i + 1 == len(texts):
                    out.append(_majority(np.concatenate(parts), np.array([len(p) for p in parts], np.int64)))
                    parts, held = [], 0
            yield pd.Series(np.concatenate(out).view(np.int64))
    return run(text.cast("binary"))


def bk_forest(keys: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees over `keys`, one per value of `root` (dense numbers): the first key of each root and a
    table whose entry (node, d) is the child at distance d, or -1."""
    child = np.full((len(keys), WIDTH + 1), -1, np.int32)
    order = np.arange(len(keys))
    _, heads = np.unique(root, return_index=True)
    rest = np.setdiff1d(order, heads, assume_unique=True)
    at = heads[root[rest]]
    while len(rest):
        d = np.bitwise_count(keys[rest] ^ keys[at]).astype(np.int64)
        slot = at * (WIDTH + 1) + d
        _, new = np.unique(slot, return_index=True)
        child.reshape(-1)[slot[new]] = rest[new]
        at = child.reshape(-1)[slot].astype(np.int64)
        stay = at != rest
        rest, at = rest[stay], at[stay]
    return heads, child


def bk_search(keys: np.ndarray, child: np.ndarray, query: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query number, node) of all keys within `radius`, level by level; a query starts at its root."""
    for block in range(0, len(query), 8192):
        q = np.arange(block, min(block + 8192, len(query)))
        node = start[q]
        while len(q):
            d = np.bitwise_count(query[q] ^ keys[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            nq, nn = [], []
            for step in range(-radius, radius + 1):
                e = d + step
                ok = (e >= 1) & (e <= WIDTH)
                c = child[node[ok], e[ok]]
                has = c >= 0
                nq.append(q[ok][has])
                nn.append(c[has].astype(np.int64))
            q, node = np.concatenate(nq), np.concatenate(nn)


def _forest(n: int, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Adds links to `low`, which names the least vertex known of each vertex's component."""
    while True:
        la, lb = low[a], low[b]
        least = np.minimum(la, lb)
        if np.array_equal(la, lb):
            return low
        np.minimum.at(low, la, least)
        np.minimum.at(low, lb, least)
        while not np.array_equal(low, low[low]):
            low = low[low]


def _linker(radius: int):
    def link(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        shard, tree, block = (table[c].to_numpy() for c in ("shard", "tree", "block"))
        order = np.lexsort((fp, shard))
        fp, shard, tree, block = fp[order], shard[order], tree[order], block[order]
        names, vertex = np.unique(fp, return_inverse=True)
        node, ask = np.flatnonzero(tree), np.flatnonzero(block)
        held, root = np.unique(shard[node], return_inverse=True)
        low = np.arange(len(names))
        if len(node):
            heads, child = bk_forest(fp[node], root)
            at = np.searchsorted(held, shard[ask])
            ok = held[np.minimum(at, len(held) - 1)] == shard[ask]
            ask, at = ask[ok], at[ok]
            for q, n in bk_search(fp[node], child, fp[ask], heads[at], radius):
                low = _forest(len(names), vertex[ask[q]], vertex[node[n]], low)
        hit = low != np.arange(len(names))
        return pa.table({"a": names[hit].view(np.int64), "b": names[low[hit]].view(np.int64)})
    return link


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp) within `radius` bits."""
    bands = [(WIDTH * i // (radius + 1), WIDTH * (i + 1) // (radius + 1)) for i in range(radius + 1)]
    value = lambda lo, hi: F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    # A shard is a band and the value there, as one long.
    dealt = prints.select("fp", F.explode(F.array(*[value(lo, hi) * (radius + 1) + i for i, (lo, hi) in enumerate(bands)])).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.filter("n > 1"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // TASK))
    cuts = F.ceil(F.col("n") / TREE).cast("int")
    rows = dealt.join(sizes, "shard").withColumn("cuts", cuts)
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    # Tree t meets block u for t <= u. A fingerprint is in tree and block `mine`, of all pairs with that number.
    pairs = F.when(F.col("cuts") == 1, F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("u")))).otherwise(
        F.array_distinct(F.concat(
            F.transform(F.sequence("mine", F.col("cuts") - 1), lambda u: F.struct(F.col("mine").alias("t"), u.alias("u"))),
            F.transform(F.sequence(F.lit(0), F.col("mine")), lambda t: F.struct(t.alias("t"), F.col("mine").alias("u"))))))
    placed = (rows.withColumn("mine", mine).withColumn("p", F.explode(pairs))
              .select("fp", "shard", (F.col("p.t") == F.col("mine")).alias("tree"), (F.col("p.u") == F.col("mine")).alias("block"),
                      F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("shard"), F.lit(parts)))
                      .otherwise(F.xxhash64("shard", "p.t", "p.u")).alias("task")))
    return placed.groupBy("task").applyInArrow(_linker(radius), "a long, b long")


def components(marked: DataFrame, radius: int = 2) -> DataFrame:
    """fp and component_id (least _doc reachable) of every distinct fingerprint of `marked` (_doc, fp)."""
    prints = materialize(marked.groupBy("fp").agg(F.min("_doc").alias("low")))
    found = materialize(links(prints.select("fp"), radius))
    if found.isEmpty():
        return prints.select("fp", F.col("low").alias("component_id"))
    linked = found.select(F.explode(F.array("a", "b")).alias("box")).distinct()
    of = materialize(connected_components(linked, found).select(F.col("box").alias("fp"), F.col("component").alias("root")))
    least = of.join(prints, "fp").groupBy("root").agg(F.min("low").alias("least"))
    of = of.join(least, "root").select("fp", "least")
    return prints.join(of, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id of every row of `docs` (doc_id, text)."""
    marked = materialize(docs.select(F.col("doc_id").alias("_doc"), fingerprint(F.col("text"), width).alias("fp")))
    # Written, so that both sides of the join are plain shuffles and a hot fingerprint can be split.
    return (marked.join(materialize(components(marked, radius)), "fp")
            .select(F.col("_doc").alias("doc_id"), F.col("fp").alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """The rows of `docs` that name their component; of rows that share such an id, the least row."""
    named = near_duplicates(docs.select("doc_id", "text"), radius, width)
    heads = materialize(named.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n")))
    kept = docs.join(heads.select(F.col("doc_id").alias("_head")), F.col("doc_id").eqNullSafe(F.col("_head")), "left_semi")
    if heads.filter("n > 1").isEmpty():
        return kept
    return kept.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
