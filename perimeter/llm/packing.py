"""Best-fit packing under conflicts.

Documents are dealt by hash to shards of bounded size, and each shard is packed by best fit, longest
piece first. Open bins stand in order of their residual, with a bitmap of the sources and one of the
duplicate clusters inside. A piece goes to the tightest bin it fits: the search starts at the least
residual that is large enough and moves to the successor while a bitmap shows a conflict. A document
longer than a bin fills bins of its own and only its last piece is packed; nothing is cut off.

Conflicts: no two pieces of one duplicate cluster share a bin. Sources: a source that holds a large part
of its shard is split into slots in proportion to its share (a bin takes `spread` x share x pieces per
bin of it, one at least), any other has one.

Cases: repeated rows are combined before the shuffle and packed as copies, each in another bin (they
are one cluster). A null size counts as 0; a document of size 0 gets one piece in no bin (bin null). Null
sources are one source, a null cluster is no cluster. Other columns are ignored; an empty table gives
an empty result."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.llm.common import WHITE

SHARD, SPREAD = 4096, 2
#: Bits of a bin's number that count within a shard.
_LOCAL = 24
SCHEMA = "doc_id long, copy int, piece int, start long, n_tokens long, bin long, bin_offset long"


def best_fit(sizes: list[int], slots: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given. Slots and clusters are bit numbers (-1: none)."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    members: list[int] = []
    bins, offsets = [], []
    for size, slot, cluster in zip(sizes, slots, clusters):
        s, c = (1 << slot) if slot >= 0 else 0, (1 << cluster) if cluster >= 0 else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (sources[open_bins[at][1]] & s or members[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
            sources[b] |= s
            members[b] |= c
        else:
            left, b = capacity, len(sources)
            sources.append(s)
            members.append(c)
        bins.append(b)
        offsets.append(capacity - left)
        if left > size:
            insort(open_bins, (left - size, b))
    return bins, offsets


def _packer(capacity: int, spread: float):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("copy", "ascending")])
        size = rows["size"].to_numpy()
        full, rest = size // capacity, size % capacity
        # Documents longer than a bin fill bins of their own; what is left is packed, longest first.
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        held = rest[order]
        cluster = np.unique(rows["cluster"].to_numpy(), return_inverse=True)[1]
        cluster = np.where(np.bincount(cluster)[cluster] > 1, cluster, -1)[order]
        source = rows["source"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()[order]
        per_bin = len(order) / max(1, -(-int(held.sum()) // capacity))
        count = np.bincount(source, minlength=1)
        lanes = np.maximum(1, np.ceil(spread * per_bin * count / max(1, len(order)))).astype(np.int64)
        rank = np.empty(len(order), np.int64)
        by = np.argsort(source, kind="stable")
        rank[by] = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)[: len(order)]
        slot = (np.cumsum(lanes) - lanes)[source] + rank % lanes[source]
        bins, offsets = best_fit(held.tolist(), slot.tolist(), cluster.tolist(), capacity)
        whole, empty = np.repeat(np.arange(len(size)), full), np.flatnonzero(size == 0)
        number = np.concatenate((np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full), full[order], 0 * empty))
        at = np.concatenate((whole, order, empty)).astype(np.int64)
        used, blank = max(bins, default=-1) + 1, [None] * len(empty)
        first = rows["shard"][0].as_py() << _LOCAL
        return pa.table({
            "doc_id": rows["doc_id"].take(at), "copy": rows["copy"].take(at), "piece": number.astype(np.int32), "start": number * capacity,
            "n_tokens": np.concatenate((np.full(len(whole), capacity), held, 0 * empty)),
            "bin": pa.array([first + b for b in (*range(used, used + len(whole)), *bins)] + blank, pa.int64()),
            "bin_offset": pa.array([0] * len(whole) + offsets + blank, pa.int64())})
    return pack


def text_cluster(text: Column) -> Column:
    """Cluster of exact duplicates: hash of the text in lower case with single spaces."""
    return F.xxhash64(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")))


def pack(docs: DataFrame, size: Column, cluster: Column, capacity: int = 2048, spread: float = SPREAD, shard: int = SHARD) -> DataFrame:
    """The pieces of all rows of `docs` (doc_id, source): piece number, first token, tokens, bin and offset in it."""
    rows = (docs.select("doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("size"), cluster.cast("long").alias("cluster"))
            .groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("n")))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).drop("n")
    # Copies of a row are one cluster, even where none is named.
    copies = copies.withColumn("cluster", F.coalesce("cluster", F.xxhash64("doc_id", "source", "size")))
    shards = max(1, -(-(docs.count()) // shard))
    dealt = copies.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_packer(capacity, spread), SCHEMA)
