"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

Both tokenizers cut a text (with a space in front) into tokens. Where a token of each ends at the same byte,
the text can be cut for both. An interval of tokens takes its middle token of A, looks from there outwards for the
nearest one whose end B has too (a bisect in B's ends), and is divided there; both halves are treated alike. An interval
without a shared end inside is a leaf and becomes a group. All intervals of a batch of texts are divided at once, level
by level, in NumPy.

Tokens are linked when their byte ranges overlap. The corpus-wide count of a pair of ids is summed from one row per
pair and chunk (a bounded run of documents, written once), and handed back to each chunk as the rows it holds, so neither
the table of pairs nor any document list goes through the driver, nothing is broadcast, and a frequent pair is at most one row
per chunk. The chunks are a bucketed table, so texts are tokenized once and their pairs never shuffled.

A is read from a byte-level BPE file whose merges are in order of their ids (checked); then merging by rank gives the same
tokens, and a text on which that fails is encoded by the plain library.

Cases: a null or empty text, or one whose tokens of A or B do not spell space+text, has no tokens: zeros and an empty
digest. Every row is a document of its own, so repeated rows and null ids each give a row, and pairs in repeated texts count each
time. Only doc_id and text are read, so other columns cannot clash. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimeter.storage import materialize

TOKENIZERS = "/opt/tokenizers"
#: Pre-tokenizer pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A batch, which is aligned at once, ends after so many characters or documents; a chunk after so many of either.
BATCH_CHARS, BATCH_DOCS, CHUNK_CHARS, CHUNK_DOCS = 1_000_000, 2_048, 16_000_000, 16_384


def byte_table() -> dict[str, int]:
    """Byte that a character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a JSON file."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_table()
        ids = {w: i for w, i in model["vocab"].items() if all(c in of for c in w)}
        spelled = {bytes(of[c] for c in w): i for w, i in ids.items()}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for b, i in spelled.items():
            self.bytes[i] = b
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        special = [i for w, i in model["vocab"].items() if w.startswith("<|") and w.endswith("|>")]
        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        self._fast = None
        if all(x < y for x, y in zip(merged, merged[1:])):
            ranks = {b: i for b, i in spelled.items() if i not in special}
            self._fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self._fast is not None:
            try:
                return self._fast.encode_ordinary(text)
            except BaseException as e:  # the pattern library panics on some very long runs of white space
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return self._plain.encode(text, add_special_tokens=False).ids


class Pieces:
    """Sentence pieces with byte fallback; the library adds the space."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self._sp.get_piece_size()):
            piece = self._sp.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._sp.encode(texts, num_threads=1) if texts else []


@cache
def pair_of(a_path: str, b_path: str) -> Pair:
    """The two tokenizers, loaded once per Python worker."""
    return Pair(ByteLevel(a_path), Pieces(b_path))


class Pair:
    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        self.length_a, self.length_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        if len(a.bytes) * len(b.bytes) >= 1 << 40:
            raise ValueError("vocabularies too large for a pair in 40 bits")
        # Decimal ids with the sign that follows them, inside a group and at its end.
        self._signs = [[np.array([f"{i}{s}" for i in range(len(t.bytes))], object) for s in (",", end)]
                       for t, end in ((a, "|"), (b, ";"))]

    def digits(self, side: int, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        inside, end = self._signs[side]
        out = inside[ids]
        out[last] = end[ids[last]]
        return out

    def pair_ids(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b * len(self.a.bytes) + a


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (token after the cut, in A and in B) at which texts fall into groups, the end of each text included.

    Ends count up over all texts of the batch; text t holds tokens first_a[t] to first_a[t + 1] of A, alike in B."""
    cut_a, cut_b = [first_a[1:]], [first_b[1:]]
    lo, hi, b_lo, b_hi = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    while len(lo):
        some = (hi - lo > 1) & (b_hi - b_lo > 1)
        lo, hi, b_lo, b_hi = lo[some], hi[some], b_lo[some], b_hi[some]
        middle, at, at_b = (lo + hi - 2) >> 1, np.full(len(lo), -1), np.zeros(len(lo), np.int64)
        open_, step = np.arange(len(lo)), 0
        while len(open_):
            for place in (step, -step) if step else (0,):
                here = middle[open_] + place
                inside = (here >= lo[open_]) & (here <= hi[open_] - 2)
                who, here = open_[inside], here[inside]
                found = np.searchsorted(ends_b, ends_a[here])
                hit = ends_b[found] == ends_a[here]
                at[who[hit]], at_b[who[hit]] = here[hit] + 1, found[hit] + 1
                open_ = open_[at[open_] < 0]
            step += 1
            left = (middle[open_] - step >= lo[open_]) | (middle[open_] + step <= hi[open_] - 2)
            open_ = open_[left]
        cut = at >= 0
        at, at_b = at[cut], at_b[cut]
        cut_a.append(at)
        cut_b.append(at_b)
        lo, hi, b_lo, b_hi = (np.concatenate(x) for x in ((lo[cut], at), (at, hi[cut]), (b_lo[cut], at_b), (at_b, b_hi[cut])))
    a, b = np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))
    return a, b


class Aligned:
    """A batch of texts, tokenized and cut. Texts that a tokenizer does not spell back have no tokens."""

    def __init__(self, pair: Pair, texts: list[str | None]) -> None:
        self.pair = pair
        whole = [n for n, t in enumerate(texts) if t]
        spell_a, spell_b = pair.a.bytes, pair.b.bytes
        ids_a, ids_b = [[] for _ in texts], [[] for _ in texts]
        for n, a, b in zip(whole, pair.a.encode([texts[n] for n in whole]), pair.b.encode([texts[n] for n in whole])):
            want = (" " + texts[n]).encode("utf-8", "replace")
            if b"".join(map(spell_a.__getitem__, a)) == want == b"".join(map(spell_b.__getitem__, b)):
                ids_a[n], ids_b[n] = a, b
        self.a, self.first_a = _flat(ids_a)
        self.b, self.first_b = _flat(ids_b)
        self.n_a, self.n_b = np.diff(self.first_a), np.diff(self.first_b)
        self.ends_a, self.ends_b = np.cumsum(pair.length_a[self.a]), np.cumsum(pair.length_b[self.b])
        told = self.n_a > 0
        self.cut_a, self.cut_b = shared_cuts(self.ends_a, self.ends_b, *(np.append(f[:-1][told], f[-1]) for f in (self.first_a, self.first_b)))
        # Text of each group.
        self.text = np.searchsorted(self.first_a, self.cut_a, "left") - 1
        self.n_groups = np.bincount(self.text, minlength=len(texts))

    def groups(self, text: int) -> list[tuple[list[int], list[int]]]:
        lo, hi = np.searchsorted(self.text, [text, text + 1])
        a = [self.first_a[text], *self.cut_a[lo:hi]]
        b = [self.first_b[text], *self.cut_b[lo:hi]]
        return [(self.a[a[i]:a[i + 1]].tolist(), self.b[b[i]:b[i + 1]].tolist()) for i in range(hi - lo)]

    def digests(self) -> list[str]:
        """SHA-256 of the groups of each text, written as `a1,a2|b1;a3|b2,b3`."""
        n, groups = len(self.a) + len(self.b), len(self.cut_a)
        if not n:
            return [""] * len(self.n_a)
        size_a, size_b = np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)
        group_a, group_b = np.repeat(np.arange(groups), size_a), np.repeat(np.arange(groups), size_b)
        # A group's tokens of A go before its tokens of B: they pass those of B in earlier groups, and the other way round.
        signs = np.empty(n, object)
        for side, ids, cuts, before in ((0, self.a, self.cut_a, (self.cut_b - size_b)[group_a]), (1, self.b, self.cut_b, self.cut_a[group_b])):
            last = np.zeros(len(ids), bool)
            last[cuts - 1] = True
            signs[np.arange(len(ids)) + before] = self.pair.digits(side, ids, last)
        out, told = [], (self.first_a + self.first_b).tolist()
        for lo, hi in zip(told, told[1:]):
            out.append(hashlib.sha256("".join(signs[lo:hi].tolist())[:-1].encode()).hexdigest() if hi > lo else "")
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair id and number of links, one row per text and pair.

        Each end of either side closes one stretch of bytes that belongs to one token of each, which is one link."""
        n = np.arange(len(self.a))
        over = np.searchsorted(self.ends_b, self.ends_a)
        own = np.ones(len(self.b), bool)
        own[over[self.ends_b[over] == self.ends_a] if len(over) else over] = False
        own = np.flatnonzero(own)
        a = np.concatenate([n, np.searchsorted(self.ends_a, self.ends_b[own])])
        b = np.concatenate([over, own])
        text = np.searchsorted(self.first_a, a, "right") - 1
        both, times = np.unique(text << 40 | self.pair.pair_ids(self.a[a], self.b[b]), return_counts=True)
        return both >> 40, both & ((1 << 40) - 1), times


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=first[1:])
    return np.fromiter(chain.from_iterable(ids), np.int64, int(first[-1])), first


def _paths(folder: str) -> tuple[str, str]:
    return f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list, list]]:
    """Bounded runs of ids and texts, with the number of the chunk they belong to."""
    ids, texts, size, chunk, held, chars = [], [], 0, 0, 0, 0
    for frame in frames:
        for i, t in zip(frame["doc_id"], frame["text"]):
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t if isinstance(t, str) else None)
            size += len(texts[-1] or "")
            if size >= BATCH_CHARS or len(ids) >= BATCH_DOCS:
                yield chunk, ids, texts
                held, chars = held + len(ids), chars + size
                if chars >= CHUNK_CHARS or held >= CHUNK_DOCS:
                    chunk, held, chars = chunk + 1, 0, 0
                ids, texts, size = [], [], 0
    if ids:
        yield chunk, ids, texts


def align(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc_id and the groups of its text in order: arrays of ids of A and of B."""
    paths = _paths(tokenizers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = pair_of(*paths)
        for _, ids, texts in _batches(frames):
            done = Aligned(pair, texts)
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "groups": [
                [{"a": a, "b": b} for a, b in done.groups(n)] for n in range(len(texts))]})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def _aligned_chunks(docs: DataFrame, tokenizers: str) -> DataFrame:
    paths = _paths(tokenizers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, part = pair_of(*paths), TaskContext.get().partitionId()
        for chunk, ids, texts in _batches(frames):
            done = Aligned(pair, texts)
            text, pairs, times = done.links()
            first = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            yield pd.DataFrame({
                "chunk": part << 32 | chunk, "doc_id": pd.array(ids, "Int64"), "n_a": done.n_a, "n_b": done.n_b, "n_groups": done.n_groups,
                "groups_sha256": done.digests(),
                "pairs": [pairs[lo:hi].astype("<u8").tobytes() for lo, hi in zip(first, first[1:])],
                "times": [times[lo:hi].astype("<u4").tobytes() for lo, hi in zip(first, first[1:])]})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary")


def _numbers(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).astype(np.int64)


def _chunk_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    pairs, where = np.unique(_numbers(frame["pairs"], "<u8"), return_inverse=True)
    n = np.bincount(where, _numbers(frame["times"], "<u4"), len(pairs)).astype(np.int64)
    return pd.DataFrame({"chunk": frame["chunk"].iloc[0] if len(frame) else 0, "pair": pairs, "n": n})


def _against_counts(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    counts = counts.sort_values("pair")
    pairs, times = _numbers(docs["pairs"], "<u8"), _numbers(docs["times"], "<u4")
    of = np.repeat(np.arange(len(docs)), [len(x) >> 2 for x in docs["times"]])
    at = np.searchsorted(counts["pair"].to_numpy(np.int64), pairs)
    count, best = counts["count"].to_numpy(np.int64), counts["best"].to_numpy(bool)
    sums = {"n_links": times, "n_best": times * best[at] if len(at) else times, "count_sum": times * count[at] if len(at) else times}
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]].copy()
    for name, value in sums.items():
        run = np.concatenate([[0], np.cumsum(value)])
        edge = np.searchsorted(of, np.arange(len(docs) + 1))
        out[name] = run[edge[1:]] - run[edge[:-1]]
    return out


def align_and_count(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Per row of `docs`: doc_id, numbers of tokens, groups and links, n_best (links whose pair is the most
    frequent one of its B id, ties included), count_sum (frequencies summed over links) and the digest of its groups."""
    spark = docs.sparkSession
    vocabulary = len(pair_of(*_paths(tokenizers)).a.bytes)
    name = f"aligned_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (_aligned_chunks(docs, tokenizers).write.option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name))
    chunks = spark.table(name)
    held = materialize(chunks.select("chunk", "pairs", "times").groupBy("chunk").applyInPandas(_chunk_pairs, "chunk long, pair long, n long"))
    total = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("_b", F.floor(F.col("pair") / vocabulary))
    total = materialize(total)
    most = total.groupBy("_b").agg(F.max("count").alias("_most"))
    told = total.join(most, "_b").select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))
    back = held.select("chunk", "pair").join(told, "pair")
    out = materialize(chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(
        _against_counts, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"))
    spark.sql(f"DROP TABLE {name}")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
