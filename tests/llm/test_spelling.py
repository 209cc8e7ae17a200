"""Spelling variants against all pairs, on small made-up vocabularies and on odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from perimeter.llm import spelling


def edits(a, b):
    """Edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def brute(vocab):
    out = []
    form = {}
    for w, n in vocab.items():
        near = sorted((-vocab[v], v) for v in vocab if abs(len(v) - len(w)) < 2 and edits(w, v) == 1)
        form[w] = near[0][1] if near and -near[0][0] >= 5 * n else None
        out.append((w, form[w], n, len(near), vocab[form[w]] if form[w] else None))
    for k, (w, f, n, m, fn) in enumerate(out):
        root = w
        while form[root]:
            root = form[root]
        out[k] = (w, f, root, n, m, fn)
    return sorted(out)


def random_vocabulary(seed, words=150):
    rng = np.random.default_rng(seed)
    letters, vocab = list("abcdeéñÿ"), {}
    for _ in range(words):
        w = "".join(rng.choice(letters, rng.integers(6, 9)))
        for step in range(5):
            vocab[w] = int(5 ** (1 + step * rng.random() * 1.5)) + 5
            at = int(rng.integers(0, len(w)))
            kind = rng.integers(0, 4)
            c = str(rng.choice(letters))
            w = [w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:], w[:at] + w[at:at + 2][::-1] + w[at + 2:]][kind]
            w = w if len(w) >= 6 else w + "abc"
    return vocab


@pytest.mark.parametrize("tile", [2048, 3])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    vocab = random_vocabulary(tile, 150 if tile > 3 else 40)
    got = spelling.group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long"))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0]) == brute(vocab)


def test_a_hot_block_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 16)
    vocab = {f"{a}{b}{c}aaa": 5 + i for i, (a, b, c) in enumerate((x, y, z) for x in "eao" for y in "eao" for z in "eaotn")}
    got = spelling.group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long"))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0]) == brute(vocab)


def test_long_chains_end_at_the_root(spark):
    vocab = {"aaaaaa" + "b" * i: 5 ** (i + 1) for i in range(12)}
    got = {r["word"]: r["root"] for r in spelling.group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaaa" + "b" * 11}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 -- _"), (None, "Éclair éclair ÉCLAIR colour" * 3), (5, "colour Colour COLOUR color×÷ color-- coloor colors " * 40), (5, "colour Colour COLOUR color×÷ color-- coloor colors " * 40),
            (6, "colour " * 20_000), (7, "x" * 70_000 + " " + "ab" * 30_000), (8, "colou1r straße STRASSE"), (9, ("colours" + "1") * 6)]
    docs = spark.createDataFrame([(i, t, "w", 3, 4) for i, t in rows], "doc_id long, text string, word string, n long, h int")
    count = Counter()
    for i, t in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in t or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    got = spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(vocab) >= 4 and sorted(map(tuple, got), key=lambda r: r[0]) == brute(vocab)
    assert spelling.variants(docs.limit(0)).count() == 0
