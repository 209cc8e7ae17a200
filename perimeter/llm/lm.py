"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are the words of a text, A-Z in lower case, and an end. Every word that has a number (below) has a restaurant of
the words that follow it, the start of a text is one more, and words without a number share `SHARED` restaurants by their last byte. All
share one parent, the restaurant of all words, whose own base is uniform over the training words and one unknown.
Seating follows the Chinese-restaurant process: a customer sits at one of the tables of its word or opens one, which sends a
customer to the parent.

It is sampled by Gibbs moves over whole dishes (`seating.py`). A round draws, given the tables so far, a weight per word in
the parent; then the tables of every pair (context, word) from their law given that weight and all customers of
the pair; then those of the word in the parent. The next round goes on from there. After a burn-in the predictive
probabilities are averaged over the samples. Discounts are estimated from counts of counts.

Counts cover every training token. Pairs of numbered words are dealt by hash into parts of about `PART` tokens, in which sorted arrays of
pairs are counted, seated and met with the tokens; other words are dealt by word, so that a word's pairs lie together. A part with
over twice as many tokens (a hot pair or word) is cut further for counting and scoring. Between rounds parts
exchange sums per context and per numbered word only. A dish's random numbers are hashes, so its tables are drawn again where they are needed, not stored.

Bounds: words get numbers if they are the most frequent of all training texts, at most `FREQUENT`, so that what
is broadcast is some ten arrays of that length. The number of pairs grows with the corpus.

Cases: a null text is empty and has one token, its end. A null id is scored and is training text or not by the
crc32 of an empty text. Repeated rows are counted and scored each on its own. Other columns are ignored, an empty table gives an empty result,
and with no training text every token has probability 1 in both models."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.llm.seating import gamma, law, mix
from perimeter.storage import materialize

FREQUENT, PART, BLOCK = 131_072, 4_000_000, 4096
SHARED, END = 32, b""
STRENGTH, BURN_IN, SAMPLES = 1.0, 2, 3
#: Most rows that are broadcast to join them.
MAX_BROADCAST = 150_000
#: A pair is word << _CTX | context; in a token, below it, one bit for held-out texts and the text's place in its batch.
_CTX, _DOC = 18, 16
_BUFFER = 500_000  # tokens a task holds at a time


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # on bytes, both know ASCII only


# ---------------------------------------------------------------- tokens

def frequent_words(training: DataFrame) -> list[bytes]:
    """Words to number: the end, and those most frequent in all training texts, by a count that keeps them within bounds, the most frequent first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(_words(t))
            if len(seen) > 500_000:
                yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    texts = training.select(F.col("text").cast("binary").alias("text"))
    counts = materialize(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    room, least = FREQUENT - 1, 1 << 62
    for n, words in sorted(map(tuple, counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        if words > room:
            break
        room, least = room - words, n
    kept = sorted((-r["n"], bytes(r["word"])) for r in counts.filter(F.col("n") >= least).collect())
    return [END, *(w for _, w in kept)]


TOKENS = "kind string, key long, doc_id long, held_out boolean, n_tokens long, part long, data binary, words binary"
_TYPES = {"kind": pa.string(), "key": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "part": pa.int64(),
          "data": pa.binary(), "words": pa.binary()}


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of small numbers, byte plane by byte plane."""
    planes = [np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(c.T).view("<u4").reshape(-1).astype(np.int64) for c in planes]


def _pack_tokens(x: np.ndarray) -> bytes:
    """Sorted tokens: steps from word to word, contexts and texts."""
    cell = x >> (_DOC + 1)
    return _pack(np.diff(cell >> _CTX, prepend=0), cell & ((1 << _CTX) - 1), x & ((2 << _DOC) - 1))


def _tokens_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, whether held out, and texts."""
    word, ctx, doc = _unpack(data, 3)
    return np.cumsum(word) << _CTX | ctx, doc >> _DOC, doc & ((1 << _DOC) - 1)


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _words_of(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split()


def _part(word: bytes, parts: int) -> int:
    return xxhash.xxh64_intdigest(word) % parts


def _tokenizer(shared, parts: int):
    """doc rows, part rows with a batch's pairs of numbered words, and rare rows with those of other words and the words."""
    def batch(kind: str, n: int, **columns) -> pa.RecordBatch:
        columns["kind"] = [kind] * n
        return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()], list(_TYPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}
        get, key = number.get, TaskContext.get().partitionId() << 36
        flat: list[bytes] = []
        docs: list[tuple[int | None, bool, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal key
            ids = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
            rare = np.flatnonzero(ids < 0)
            makes = ids.copy()
            makes[rare] = len(number) + np.array([flat[i][-1] & (SHARED - 1) for i in rare], np.int64)
            ctx = np.concatenate(([0], makes[:-1]))  # the end has number 0, which is also the start
            n = np.array([d[2] for d in docs])
            doc, held = np.repeat(np.arange(len(docs)), n), np.array([d[1] for d in docs])
            known = ids >= 0
            x = np.sort((((ids << _CTX | ctx) << 1 | held[doc]) << _DOC | doc)[known])
            part = (mix((x >> (_DOC + 1)).astype(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts <= 65_536 else np.int64)
            order = np.argsort(part, kind="stable")
            x, part = x[order], part[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            pieces = np.split(x, first[1:])
            yield batch("doc", len(docs), key=key + np.arange(len(docs)), doc_id=[d[0] for d in docs], held_out=held, n_tokens=n)
            yield batch("part", len(first), key=np.full(len(first), key), part=part[first].astype(np.int64), n_tokens=[len(p) for p in pieces], data=[_pack_tokens(p) for p in pieces])
            # Other words lie by part; a token holds its word's place among those of the part.
            words = sorted({flat[i] for i in rare}, key=lambda v: (_part(v, parts), v))
            place, home = {v: i for i, v in enumerate(words)}, np.array([_part(v, parts) for v in words], np.int64)
            code = np.fromiter((place[flat[i]] for i in rare), np.int64, len(rare))
            x = np.sort(code << (_CTX + _DOC + 1) | ctx[rare] << (_DOC + 1) | held[doc[rare]].astype(np.int64) << _DOC | doc[rare])
            first = np.flatnonzero(np.diff(home, prepend=-1))
            ends = np.append(first[1:], len(words))
            pieces = np.split(x, np.searchsorted(x, first[1:] << (_CTX + _DOC + 1))) if len(first) else []
            yield batch("rare", len(first), key=np.full(len(first), key), part=home[first], n_tokens=[len(p) for p in pieces],
                        data=[_pack_tokens(p - (i << (_CTX + _DOC + 1))) for p, i in zip(pieces, first)], words=[_pack_words(words[i:j]) for i, j in zip(first, ends)])
            key += 1 << _DOC
            flat.clear()
            docs.clear()
        for b in batches:
            for i, t, held in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))):
                w = _words(t)
                flat.extend(w)
                flat.append(END)
                docs.append((i, held, len(w) + 1))
                if len(flat) > _BUFFER or len(docs) == 1 << _DOC:
                    yield from flush()
        if docs:
            yield from flush()
    return run


# ---------------------------------------------------------------- sums

def _blocks(name: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Array `name` in blocks, those that are not all zero."""
    for at in range(0, len(values), BLOCK):
        if (x := np.asarray(values[at: at + BLOCK], np.int64)).any():
            yield pa.record_batch([pa.array([name], pa.int32()), pa.array([at // BLOCK], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)])], ["name", "block", "data"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for name, block, data in zip(*(c.to_pylist() for c in b.columns)):
            x = np.frombuffer(zlib.decompress(data), np.int64)
            held[name, block] = held[name, block] + x if (name, block) in held else x
    yield pa.record_batch([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()),
                           pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["name", "block", "data"])


_BLOCK_ROW = "name int, block int, data binary"


def _sums(blocks: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Sums of the arrays 0, 1, ... over all tasks."""
    out = [np.zeros(n, np.int64) for n in sizes]
    for r in blocks.repartition("name", "block").mapInArrow(_add, _BLOCK_ROW).collect():
        out[r["name"]][r["block"] * BLOCK: (r["block"] + 1) * BLOCK] += np.frombuffer(zlib.decompress(r["data"]), np.int64)
    return out


# ---------------------------------------------------------------- seating

@dataclass
class State:
    """What the restaurants tell each other before a round."""

    opening: np.ndarray  # weight of a new table per context
    weight: np.ndarray   # drawn weight of each numbered word in the parent
    parent: np.ndarray   # its predictive probability there
    new: float           # customers' worth of a word without customers in the parent
    total: float         # strength and customers of the parent


@dataclass
class Restaurants:
    discount: float
    top_discount: float
    customers: np.ndarray  # per context
    words: int

    def state(self, tables: np.ndarray, c0: np.ndarray, t0: np.ndarray, top: float, h: np.ndarray, step: int) -> State:
        """State from tables per context, customers and tables of numbered words in the parent, and all tables there."""
        new, total = (STRENGTH + self.top_discount * top) / (self.words + 1), STRENGTH + float(tables.sum())
        return State(STRENGTH + self.discount * tables, (gamma(c0 - self.top_discount * t0, h, step) + new) / total,
                     (c0 - self.top_discount * t0 + new) / total, new, total)

    def tables(self, n: np.ndarray, ctx: np.ndarray, weight: np.ndarray, h: np.ndarray, state: State, step: int) -> np.ndarray:
        """Tables of pairs with n customers."""
        return law(self.discount).draw(n, np.log(state.opening[ctx] * weight), h, step)

    def top_tables(self, c0: np.ndarray, h: np.ndarray, state: State, step: int) -> np.ndarray:
        return law(self.top_discount).draw(c0, np.full(len(c0), np.log(state.new)), h, 1000 + step)

    def chain(self, h: np.ndarray, word: np.ndarray, ctx: np.ndarray, n: np.ndarray, states: list[State]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rounds of words that lie here whole (word: place in h of each pair): tables, and customers and tables in the parent."""
        c0 = np.bincount(word, minlength=len(h))
        t0 = np.minimum(c0, 1)
        hp = mix(h[word] ^ mix(ctx.astype(np.uint64)))
        for step, s in enumerate(states):
            weight = (gamma(c0 - self.top_discount * t0, h, step) + s.new) / s.total
            tables = self.tables(n, ctx, weight[word], hp, s, step)
            c0 = np.bincount(word, weights=tables, minlength=len(h)).astype(np.int64)
            t0 = self.top_tables(c0, h, s, step)
            yield tables, c0, t0


def _merge(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells, kind="stable")
    cells, n = cells[order], n[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[first], np.add.reduceat(n, first) if len(first) else n


def _pair_row(cells: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    return _pack(np.diff(cells >> _CTX, prepend=0), cells & ((1 << _CTX) - 1)), zstandard.ZstdCompressor(level=1).compress(n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _pairs_of(cells: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    word, ctx = _unpack(cells, 2)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(n), np.uint8).reshape(8, -1)
    return np.cumsum(word) << _CTX | ctx, np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of the pairs of each batch of tokens."""
    for b in batches:
        rows = []
        for data in b.column("data").to_pylist():
            cells, held, _ = _tokens_of(data)
            cells = cells[held == 0]
            rows.append(_pair_row(*_merge(cells, np.ones(len(cells), np.int64))))
        yield pa.record_batch([b.column("part"), b.column("b"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                               b.column("words")], ["part", "b", "cells", "n", "words"])


def _gather(rows: pa.Table) -> pa.Table:
    """Sums of the counts of a part, or of a cut of one; for words without numbers with the training words it has."""
    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    place: dict[bytes, int] | None = {} if rows["words"].null_count == 0 else None
    for i, (a, b, v) in enumerate(zip(rows["cells"], rows["n"], rows["words"])):
        cells, n = _pairs_of(a.as_py(), b.as_py())
        if place is not None:
            words = _words_of(v.as_py())
            to = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
            cells = to[cells >> _CTX] << _CTX | cells & ((1 << _CTX) - 1)
        held.append((cells, n))
        size += len(cells)
        if size > PART // 2 or i + 1 == rows.num_rows:
            held, size = [_merge(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))], 0
    cells, n = held[0]
    packed = None
    if place is not None:
        every, used = list(place), np.unique(cells >> _CTX)
        kept = sorted(used.tolist(), key=every.__getitem__)
        to = np.zeros(len(every), np.int64)
        to[kept] = np.arange(len(kept))
        cells, n = _merge(to[cells >> _CTX] << _CTX | cells & ((1 << _CTX) - 1), n)
        packed = _pack_words([every[k] for k in kept])
    a, b = _pair_row(cells, n)
    return pa.table({"part": rows["part"][:1], "cells": pa.array([a]), "n": pa.array([b]), "words": pa.array([packed], pa.binary())})


def _pair_sums(words: int, contexts: int):
    """Customers and pairs per context, customers and pairs per numbered word, pairs of one and of two customers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(k, np.int64) for k in (contexts, contexts, words, words, 2)]
        for b in batches:
            for a, m in zip(b.column("cells").to_pylist(), b.column("n").to_pylist()):
                cells, n = _pairs_of(a, m)
                u, w = cells & ((1 << _CTX) - 1), cells >> _CTX
                for s, at, x in ((0, u, n), (1, u, None), (2, w, n), (3, w, None)):
                    sums[s] += np.bincount(at, weights=x, minlength=len(sums[s])).astype(np.int64)
                sums[4] += [(n == 1).sum(), (n == 2).sum()]
        for name, x in enumerate(sums):
            yield from _blocks(name, x)
    return run


def _seat_pairs(shared, step: int):
    """Tables beyond one per pair, per context and per numbered word, of a round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, states = shared.value
        s = states[step]
        by_ctx, by_word = np.zeros(len(s.opening), np.int64), np.zeros(len(s.weight), np.int64)
        for b in batches:
            for a, m in zip(b.column("cells").to_pylist(), b.column("n").to_pylist()):
                cells, n = _pairs_of(a, m)
                cells, n = cells[n > 1], n[n > 1]
                u, w = cells & ((1 << _CTX) - 1), cells >> _CTX
                more = rest.tables(n, u, s.weight[w], mix(cells.astype(np.uint64)), s, step) - 1
                by_ctx += np.bincount(u, weights=more, minlength=len(by_ctx)).astype(np.int64)
                by_word += np.bincount(w, weights=more, minlength=len(by_word)).astype(np.int64)
        yield from _blocks(0, by_ctx)
        yield from _blocks(1, by_word)
    return run


def _rare(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rare_sums(contexts: int):
    """The same sums of other words, and how many of them have one context, two, and more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(k, np.int64) for k in (contexts, contexts, 0, 0, 2, 3)]
        for b in batches:
            for a, m in zip(b.column("cells").to_pylist(), b.column("n").to_pylist()):
                cells, n = _pairs_of(a, m)
                u, follows = cells & ((1 << _CTX) - 1), np.bincount(cells >> _CTX)
                sums[0] += np.bincount(u, weights=n, minlength=contexts).astype(np.int64)
                sums[1] += np.bincount(u, minlength=contexts)
                sums[4] += [(n == 1).sum(), (n == 2).sum()]
                sums[5] += [(follows == 1).sum(), (follows == 2).sum(), (follows > 2).sum()]
        for name, x in enumerate(sums):
            yield from _blocks(name, x)
    return run


def _seat_rare(shared, step: int):
    """The tables of other words, and their tables in the parent. Rounds before are drawn again for words that can move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, states = shared.value
        s, by_ctx, top = states[step], np.zeros(len(states[0].opening), np.int64), 0
        for b in batches:
            for a, m, v in zip(*(b.column(c).to_pylist() for c in ("cells", "n", "words"))):
                cells, n = _pairs_of(a, m)
                h, word, ctx = _rare(_words_of(v)), cells >> _CTX, cells & ((1 << _CTX) - 1)
                moves = np.zeros(len(h), bool)
                moves[word[n > 1]] = True
                top += int(rest.top_tables(np.bincount(word, minlength=len(h))[~moves], h[~moves], s, step).sum())
                mine, place = moves[word], np.cumsum(moves) - 1
                for tables, _, t0 in rest.chain(h[moves], place[word[mine]], ctx[mine], n[mine], states[:step + 1]):
                    pass
                by_ctx += np.bincount(ctx[mine], weights=tables - 1, minlength=len(by_ctx)).astype(np.int64)
                top += int(t0.sum())
        yield from _blocks(0, by_ctx)
        yield from _blocks(2, np.array([top]))
    return run


@dataclass
class Fitted:
    rest: Restaurants
    states: list[State]
    counts: np.ndarray   # training tokens of the numbered words
    pairs: DataFrame     # counts of pairs of numbered words, per part
    rare: DataFrame      # the same of all other training words, with the words


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def fit(cut: DataFrame, words: int, again: bool) -> Fitted:
    """Model of tokens (kind, part, b, key, data, words) of which `words` have numbers. `again`: some part is cut, so that counts are gathered twice."""
    spark, contexts = cut.sparkSession, words + SHARED
    row = "part long, cells binary, n binary, words binary"

    def gathered(kind: str) -> DataFrame:
        counted = cut.filter(F.col("kind") == kind).select("part", "b", "data", "words").mapInArrow(_count, "part long, b int, cells binary, n binary, words binary")
        if again:
            counted = counted.groupBy("part", "b").applyInArrow(_gather, row)
        return materialize(counted.groupBy("part").applyInArrow(_gather, row))
    pairs, rare = gathered("part"), gathered("rare")
    both = pairs.mapInArrow(_pair_sums(words, contexts), _BLOCK_ROW).unionByName(rare.mapInArrow(_rare_sums(contexts), _BLOCK_ROW))
    customers, many, counts, follows, few, sizes = _sums(both, [contexts, contexts, words, words, 2, 3])
    one, two = ((follows == k).sum() + sizes[k - 1] for k in (1, 2))
    rest = Restaurants(_discount(*map(float, few)), _discount(float(one), float(two)), customers, int((counts > 0).sum() + sizes.sum()))
    h = mix(np.arange(words, dtype=np.uint64))
    states = [rest.state(many, follows, np.minimum(follows, 1), rest.words, h, 0)]
    for step in range(BURN_IN + SAMPLES):
        shared = spark.sparkContext.broadcast((rest, states))
        more, by_word, top = _sums(pairs.mapInArrow(_seat_pairs(shared, step), _BLOCK_ROW).unionByName(
            rare.mapInArrow(_seat_rare(shared, step), _BLOCK_ROW)), [contexts, words, 1])
        c0 = follows + by_word
        t0 = rest.top_tables(c0, h, states[-1], step)
        states.append(rest.state(many + more, c0, t0, float(top[0] + t0.sum()), h, step + 1))
    return Fitted(rest, states, counts, pairs, rare)


# ---------------------------------------------------------------- scores

_SCORES = "key long, doc array<int>, k array<long>, b array<double>, s array<double>"


def _score_rows(left: pa.Table, score) -> pa.Table:
    """A row per batch: sums per text of what `score` gives for its pairs (and words): known, base and model."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for data, words in zip(left["data"], left["words"]):
        cell, _, doc = _tokens_of(data.as_py())
        held = np.flatnonzero(np.bincount(doc))
        for to, x in zip(out, (held, *(np.bincount(doc, weights=v)[held] for v in score(cell, words.as_py())))):
            to.append(x)
    kinds = dict(doc=pa.int32(), k=pa.int64(), b=pa.float64(), s=pa.float64())
    return pa.table({"key": left["key"], **{c: pa.array([x.astype(t.to_pandas_dtype()) for x in v], pa.list_(t)) for (c, t), v in zip(kinds.items(), out)}})


def _add_scores(rows: pa.Table) -> pa.Table:
    """The sums of a batch's texts over all parts."""
    flat = {c: rows[c].combine_chunks().flatten().to_numpy() for c in ("doc", "k", "b", "s")}
    sums = {c: np.bincount(flat["doc"], weights=flat[c]) for c in "kbs"}
    held = np.flatnonzero(np.bincount(flat["doc"]))
    return pa.table({"key": rows["key"][0].as_py() + held, "k": sums["k"][held].astype(np.int64), "b": sums["b"][held], "s": sums["s"][held]})


def _own(cells: np.ndarray, cell: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Customers less discounts of each pair in `cell`, 0 for pairs not in training."""
    at = np.searchsorted(cells, cell)
    return np.where(cells[at] == cell, own[at], 0.0)


def _scorer(shared):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # left: batches of a part's tokens; right: the part's pairs
        rest, states, counts, floor = shared.value
        base = np.log10((counts + 0.1) / floor)
        cells, n = _pairs_of(right["cells"][0].as_py(), right["n"][0].as_py()) if right.num_rows and left.num_rows else (np.zeros(0, np.int64),) * 2
        own, u, w, h = n.astype(float), cells & ((1 << _CTX) - 1), cells >> _CTX, mix(cells.astype(np.uint64))
        for step in range(BURN_IN, BURN_IN + SAMPLES):
            own -= rest.discount * rest.tables(n, u, states[step].weight[w], h, states[step], step) / SAMPLES
        cells, own = np.append(cells, 1 << 60), np.append(own, 0.0)

        def score(cell: np.ndarray, _):
            u, w = cell & ((1 << _CTX) - 1), cell >> _CTX
            p = _own(cells, cell, own)
            for s in states[BURN_IN + 1:]:
                p += s.opening[u] * s.parent[w] / SAMPLES
            return counts[w] > 0, base[w], np.log10(p / (STRENGTH + rest.customers[u]))
        return _score_rows(left, score)
    return run


def _rare_scorer(shared):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rest, states, _, floor = shared.value
        words, cells, n = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if right.num_rows and left.num_rows:
            words, (cells, n) = _words_of(right["words"][0].as_py()), _pairs_of(right["cells"][0].as_py(), right["n"][0].as_py())
        number, own = {w: i for i, w in enumerate(words)}, n.astype(float)
        # One word more stands for those not in training.
        counts = np.bincount(cells >> _CTX, weights=n, minlength=len(words) + 1)
        parents = np.array([[s.new / s.total for s in states[BURN_IN + 1:]]]).repeat(len(counts), axis=0)
        for step, (tables, c0, t0) in enumerate(rest.chain(_rare(words), cells >> _CTX, cells & ((1 << _CTX) - 1), n, states[:-1])):
            if step >= BURN_IN:
                own -= rest.discount * tables / SAMPLES
                parents[:-1, step - BURN_IN] += (c0 - rest.top_discount * t0) / states[step + 1].total
        cells, own, base = np.append(cells, 1 << 60), np.append(own, 0.0), np.log10((counts + 0.1) / floor)

        def score(cell: np.ndarray, packed: bytes):
            mine = _words_of(packed)
            w = np.fromiter((number.get(v, len(words)) for v in mine), np.int64, len(mine))[cell >> _CTX]
            u = cell & ((1 << _CTX) - 1)
            p = _own(cells, w << _CTX | u, own)
            for i, s in enumerate(states[BURN_IN + 1:]):
                p += s.opening[u] * parents[w, i] / SAMPLES
            return counts[w] > 0, base[w], np.log10(p / (STRENGTH + rest.customers[u]))
        return _score_rows(left, score)
    return run


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.sum(F.length("text")).alias("size")).first()["size"]
    frequent = frequent_words(rows.filter("NOT held_out"))
    # A token has six bytes or so.
    parts = max(1, -(-(size or 0) // (6 * PART)))
    tokens = materialize(rows.mapInArrow(_tokenizer(spark.sparkContext.broadcast(frequent), parts), TOKENS))
    part = tokens.filter("kind <> 'doc'").select("kind", "part", "key", "data", "words", "n_tokens")
    cuts = part.groupBy("kind", "part").agg(F.ceil(F.sum("n_tokens") / (2 * PART)).cast("int").alias("many"))
    # A row per part and kind: sent to every task while that is a few MB.
    cuts = materialize(cuts)
    again = (cuts.agg(F.max("many")).first()[0] or 1) > 1
    cuts = F.broadcast(cuts) if parts <= MAX_BROADCAST else cuts
    cut = part.join(cuts, ["kind", "part"]).select("kind", "part", F.pmod(F.xxhash64("key"), F.col("many")).cast("int").alias("b"), "key", "data", "words")
    model = fit(cut, len(frequent), again)
    rest = model.rest
    total = int(rest.customers.sum())
    shared = spark.sparkContext.broadcast((rest, model.states, model.counts, total + 0.1 * (rest.words + 1)))

    def scored(kind: str, pairs: DataFrame, scorer) -> DataFrame:
        pairs = pairs.withColumn("kind", F.lit(kind)).join(cuts, ["kind", "part"]).select("part", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("b"), "cells", "n", "words")
        return cut.filter(F.col("kind") == kind).groupBy("part", "b").cogroup(pairs.groupBy("part", "b")).applyInArrow(scorer, _SCORES)
    both = scored("part", model.pairs, _scorer(shared)).unionByName(scored("rare", model.rare, _rare_scorer(shared)))
    sums = both.groupBy("key").applyInArrow(_add_scores, "key long, k long, b double, s double")
    return tokens.filter("kind = 'doc'").select("key", "doc_id", "held_out", "n_tokens").join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", F.col("k").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("b").alias("base_score"), F.col("s").alias("score"))
