"""One-permutation MinHash with optimal densification against a plain version over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from perimeter.llm import fingerprints, queries

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def brute(text):
    """Low bits of every bin."""
    steps, starts, _ = fingerprints._draws()
    least = {}
    for gram in shingles(text):
        h = 42
        for word in gram:
            h = xxhash.xxh64_intdigest(word, h)
        b, v = (h >> 48) * fingerprints.BINS >> 16, h & (1 << 47) - 1
        least[b] = min(v, least.get(b, v))
    out = []
    for i in range(fingerprints.BINS):
        at, t = i, 0
        while at not in least:
            at, t = (starts[i] + steps[i] * t) % fingerprints.BINS, t + 1
        out.append(least[at] & 15)
    return out


def as_hex(values):
    return "".join("".join(f"{x:x}" for x in values[n:n + 16]).rjust(16, "0") for n in range(0, len(values), 16))


def near(a, b):
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    return min(1.0, max(0.0, (same - 1 / 16) / (15 / 16)))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    prints, out = [brute(t) for _, t in rows], []
    for n, (i, t) in enumerate(rows):
        t, m = t or "", (n + 1) % len(rows)
        half = len(t) // 2
        edited = t[:len(t) - half] + (rows[m][1] or "")[:half]
        other = brute(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_hex(prints[n]), as_hex(other),
                    round(near(prints[n], other), 9), round(near(prints[n], prints[m]), 9)))
    return out


def rounded(rows):
    return [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in rows]


@pytest.mark.parametrize("chars", [64_000_000, 150_000])
def test_whole_table(spark, monkeypatch, chars):
    """In one range of ids, and in some fifteen."""
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", chars)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rounded(queries.QUERIES["op12_document_fingerprints"](spark, SF).collect())
    assert sorted(got) == sorted(expected(docs))


def test_odd_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 500_000)
    rows = [(None, "the first of all"), (1, None), (2, ""), (3, " \t"), (5, "one"), (9, "ONE\nTwo three"), (11, "wörter – ohne ende 🎉🎉 und so weiter"),
            (-4, " ".join(f"w{i % 977}x{i % 31}" for i in range(300_000))), (20, "a b c d e f g h i j k l m n o p"), (21, "a b c d e f g h i j k l m n o p")]
    schema = "doc_id long, text string, print string, next int, _range int, _order int"
    make = lambda r: spark.createDataFrame([(*x, "p", 1, 2, 3) for x in r], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    run = lambda: rounded(queries.QUERIES["op12_document_fingerprints"](spark, str(tmp_path)).collect())
    make(rows)
    assert Counter(run()) == Counter(expected(rows))
    twice = [(7, "same text here")] * 3 + [(8, "another")]
    make(twice)
    assert Counter(run()) == Counter(expected(twice))
    make([])
    assert run() == []


def test_every_number_of_filled_bins(spark):
    """Both ways of borrowing find the same bin, and no bin stays empty."""
    texts = [" ".join(f"t{n}w{i}" for i in range(n)) for n in [*range(5, 60), 100, 400, 3000]]
    got = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string").select("n", fingerprints.hexed(fingerprints.fingerprint(F.col("text"))).alias("p"))
    assert {r["n"]: r["p"] for r in got.collect()} == {n: as_hex(brute(t)) for n, t in enumerate(texts)}


@pytest.mark.parametrize("size", [40, 300, 2000])
def test_likeness_is_near_jaccard(spark, size):
    rng, rows = np.random.default_rng(size), []
    for k in range(120):
        a = [f"w{x}" for x in rng.integers(0, 10_000, size)]
        b = list(a)
        cut = int(rng.integers(0, size))
        b[cut:] = [f"v{x}" for x in rng.integers(0, 10_000, size - cut)]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        rows.append((k, " ".join(a), " ".join(b), len(x & y) / len(x | y)))
    df = spark.createDataFrame(rows, "k int, a string, b string, j double")
    df = df.select("j", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("got"))
    off = np.array([r["got"] - r["j"] for r in df.collect()])
    assert np.sqrt((off ** 2).mean()) < 0.07 and abs(off.mean()) < 0.02
