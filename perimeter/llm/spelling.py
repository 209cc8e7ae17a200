"""Spelling variants by blocked Gram matrices.

Words of a corpus (frequent enough and long enough) are vectors of letter counts. Two words one edit apart have a
squared distance of 1 (a letter more) or 2 (a letter replaced), and lengths that differ by one at most. So words are
laid in blocks by length, and within a length by how many of their letters fall into each of six classes: one
edit moves a word to the same block, to one where a letter has changed its class, or to one of the next length, so
only these few blocks meet. A block is cut into bounded tiles; for a pair of tiles NumPy multiplies the count matrices, which gives all
squared distances at once, and only pairs at most two apart are verified letter by letter. A task holds two tiles, never a block.

Counting is one aggregate that combines before it shuffles, so a frequent word is a row per task. The vocabulary, its
links and forms are tables; roots are found by pointer jumping, in as many joins as the logarithm of the longest possible chain.

Cases: a null text has no words. A null doc_id is written as an empty string where noise is drawn from it. Repeated rows count each
time. Words that differ only in order of letters are at distance 0 and fail the check. Ties between near words
of equal count go to the first in code-point order. Other columns are not read; an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.llm.common import LOWER, UPPER
from perimeter.storage import materialize

#: A letter: ASCII, or of the Latin-1 supplement from U+00C0 on.
LETTERS = "A-Za-zÀ-ÿ"
#: Words must be this long and this frequent; a form is so many times as frequent as the word it replaces.
LEAST_LENGTH, LEAST_COUNT, LEAD = 6, 5, 5
#: One in so many runs loses a letter (contract of the query: variants planted by a rule).
NOISE = 199
#: Words in a tile.
TILE = 2048
#: Letters of each class but the last, which holds all others. Any split is right; these are about equally frequent in prose.
CLASSES = ("ea", "io", "tnr", "hsd", "lcm")
_ALPHABET = [*LOWER, *map(chr, range(0xC0, 0x100))]
_COLUMN = {c: n for n, c in enumerate(_ALPHABET)}


def runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """doc_id and every maximal run of letters of its text of `least` letters or more, A to Z in lower case."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def with_noise(found: DataFrame) -> DataFrame:
    """Runs less one letter where a hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("_h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select("run", h.alias("_h")).select(F.when(F.col("_h") % NOISE == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word and n, for words long and frequent enough."""
    return (words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= LEAST_COUNT))


def _shape() -> Column:
    """Block of a word: letters of each class, the last class by the rest."""
    of = [F.length("word") - F.length(F.translate("word", c, "")) for c in CLASSES]
    rest = F.length("word")
    for c in of:
        rest = rest - c
    return F.array(*of, rest)


def _moves() -> list[list[int]]:
    """Differences between the blocks of two near words, each pair of blocks from one side only."""
    n = len(CLASSES) + 1
    unit = [[int(i == j) for j in range(n)] for i in range(n)]
    swaps = [[a - b for a, b in zip(unit[i], unit[j])] for i in range(n) for j in range(i)]
    return [[0] * n, *unit, *swaps]


def _tiles(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words with the tile they lie in, and all pairs of tiles that can hold near words."""
    blocked = vocab.select("word", "n", _shape().alias("block"))
    blocks = materialize(blocked.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    placed = (blocked.join(blocks, "block")
              .select("word", "n", "block", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int").alias("tile")))
    moves = F.array(*[F.array(*map(F.lit, m)) for m in _moves()])
    other = blocks.select(F.col("block").alias("block_b"), F.col("tiles").alias("tiles_b"))
    met = (blocks.withColumn("move", F.explode(moves))
           .withColumn("block_b", F.zip_with("block", "move", lambda a, b: a + b)).join(other, "block_b"))
    both = (met.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumn("tile_b", F.explode(F.sequence(F.lit(0), F.col("tiles_b") - 1)))
            .filter((F.col("block") != F.col("block_b")) | (F.col("tile") <= F.col("tile_b"))))
    return placed, both.select("block", "tile", "block_b", "tile_b")


def counts_of(words: list[str], kind: type) -> np.ndarray:
    """One row of letter counts per word."""
    out = np.zeros((len(words), len(_ALPHABET)), kind)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    column = np.fromiter((_COLUMN[c] for w in words for c in w), np.int64, len(row))
    np.add.at(out, (row, column), 1)
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether one letter inserted, deleted or replaced turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return at < len(a) and a[at + 1:] == b[at + 1:]
    return len(b) == len(a) + 1 and a[at:] == b[at + 1:]


def near_pairs(a: list[str], b: list[str] | None = None) -> list[tuple[int, int]]:
    """Positions of near words of two tiles, or within one."""
    # All terms of a distance are whole numbers up to twice the squared length, which single precision holds to 2^24.
    kind = np.float32 if max(map(len, a + (b or [])), default=0) < 2048 else np.float64
    x = counts_of(a, kind)
    y = x if b is None else counts_of(b, kind)
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    close = square <= 2.5
    if b is None:
        close, b = np.triu(close, 1), a
    return [(int(i), int(j)) for i, j in np.argwhere(close) if one_edit(a[i], b[j])]


def _meet(side: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near words of one pair of tiles, from both sides."""
    alone = (side == 2).any()
    a = np.flatnonzero(side != 1)
    b = a if alone else np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return word[:0], word[:0], n[:0]
    i, j = np.array(near_pairs(word[a].tolist(), None if alone else word[b].tolist()), np.int64).reshape(-1, 2).T
    i, j = a[i], b[j]
    return np.concatenate([word[i], word[j]]), np.concatenate([word[j], word[i]]), np.concatenate([n[j], n[i]])


def _meet_in_turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that lie in order of their pair; a pair may go on in the next batch."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object), np.empty(0, np.int64)]

    def met(edges: list[int]) -> pd.DataFrame:
        done = [_meet(*(c[lo:hi] for c in held[1:])) for lo, hi in zip(edges, edges[1:])]
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("word", "near", "near_n"), zip(*done))})
    for frame in frames:
        held = [np.concatenate([old, frame[c].to_numpy(old.dtype)]) for old, c in zip(held, ("pair", "side", "word", "n"))]
        edges = [0, *(np.flatnonzero(np.diff(held[0])) + 1).tolist()]
        if len(edges) > 1:
            yield met(edges)
        held = [c[edges[-1]:] for c in held]
    if len(held[0]):
        yield met([0, len(held[0])])


def near_words(vocab: DataFrame) -> DataFrame:
    """word, near and near_n: every pair of words one edit apart, from both sides."""
    placed, both = _tiles(vocab)
    # Numbers given while rows are written hold for all readers of the table.
    placed, both = materialize(placed), materialize(both.withColumn("pair", F.monotonically_increasing_id()))
    # Side 2: a tile against itself.
    side = F.when((F.col("block") == F.col("block_b")) & (F.col("tile") == F.col("tile_b")), 2).otherwise(0).alias("side")
    left = both.select("pair", "block", "tile", side).join(placed, ["block", "tile"]).select("pair", "side", "word", "n")
    right = (both.filter(side == 0).select("pair", F.col("block_b").alias("block"), F.col("tile_b").alias("tile")).join(placed, ["block", "tile"])
             .select("pair", F.lit(1).alias("side"), "word", "n"))
    # Most pairs are small, so a task takes one after the other.
    dealt = left.unionByName(right).repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInPandas(_meet_in_turn, "word string, near string, near_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word and root, for the words that have a form. Counts grow by `LEAD` from a word to its form, so no chain is longer
    than the logarithm of the largest count, and each join doubles the steps taken."""
    longest = max(1, math.ceil(math.log(max(most, LEAD) / LEAST_COUNT, LEAD) + 1e-9))
    chain = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        step = chain.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        chain = materialize(chain.join(step, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")))
    return chain


def group_variants(vocab: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of a vocabulary (word, n)."""
    vocab = materialize(vocab.select("word", F.col("n").cast("long")))
    best = (near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("lead"), "near")).alias("best"))
            .select("word", "n_near", "best.near", (-F.col("best.lead")).alias("near_n")))
    leads = F.col("near_n") >= LEAD * F.col("n")
    told = materialize(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("near")).alias("form"), F.when(leads, F.col("near_n")).alias("form_n")))
    most = vocab.agg(F.max("n")).first()[0] or 0
    root = roots(told.filter("form IS NOT NULL"), most)
    return told.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of whole texts, after the noise of the contract, which makes no run longer."""
    return group_variants(vocabulary(with_noise(runs(docs, LEAST_LENGTH))))
