"""Findings of the second review, each on small data against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_heads(texts):
    """Least id of each component of texts of 5-word Jaccard 0.8 or more, by all pairs."""
    ids, low, sets, holds = sorted(texts), {}, {}, {}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for i in ids:
        low[i], s = i, grams(texts[i])
        both = {}
        for g in s:
            for j in holds.setdefault(g, []):
                both[j] = both.get(j, 0) + 1
            holds[g].append(i)
        if not s:
            both = {j: 0 for j in sets if not sets[j]}
        for j, n in both.items():
            if not s or 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                low[b] = a
        sets[i] = s
    return {i: find(i) for i in ids}


def test_stage_drops_edited_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = jaccard_heads({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == set(want.values())


def test_similar_sets_in_blocks(spark, monkeypatch):
    from perimeter.llm import neardup
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 200, i % 7):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{x}" for x in rng.integers(0, 5000, 80))) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_heads(dict(rows))


def recall(spark, x, k=20):
    from perimeter.llm import vectors
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked, got = list(range(0, len(x), max(1, len(x) // 200))), {}
    for r in vectors.nearest(rows.filter(F.col("vec_id") % max(1, len(x) // 200) == 0), rows, k).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in asked:
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert len(got[q]) == min(k, len(x) - 1)
        hits += min(k, int((s[list(got[q])] >= np.sort(s)[-k] - 1e-12).sum()))
    return hits / (k * len(asked))


def unit(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_lists_read_grow_with_lists(spark, monkeypatch):
    from perimeter.llm import vectors
    monkeypatch.setattr(vectors, "PROBES", 4)
    # A table of 219 lists, of which 28 are read (4 before: recall under 0.5).
    assert recall(spark, unit(np.random.default_rng(1), 12_000)) >= 0.8


@pytest.mark.parametrize("groups,size,noise", [(3, 10, 1e-4), (200, 8, 0.0)])
def test_small_tight_clusters_are_not_short(spark, groups, size, noise):
    rng = np.random.default_rng(2)
    x = np.repeat(unit(rng, groups), size, axis=0)
    assert recall(spark, x + noise * rng.normal(size=x.shape)) >= 0.9


def test_language_stage_acts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng, most = np.random.default_rng(6), docs.agg(F.max("doc_id")).first()[0]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    junk = [(most + 1 + i, " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(60)), None, "a", 0) for i in range(10)]
    wrong = [(most + 100 + i, r["text"], "en", r["source"], r["n_chars"]) for i, r in enumerate(
        docs.filter("lang = 'de' AND n_chars > 500").orderBy("doc_id").limit(10).collect())]
    extra = spark.createDataFrame(junk + wrong, docs.schema)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs.unionByName(extra), SF).collect()}
    assert not {r[0] for r in junk} & set(got)
    assert all(got[r[0]] == "de" for r in wrong)
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= set(got)


@pytest.mark.parametrize("huge", [6_000, 300_000])
def test_mix_passes_over_long_documents(spark, huge):
    """A source of small documents and one of more words than its target, for many hash seeds."""
    from perimeter.llm import mixing
    rows = [(0, "b", huge)] + [(i, "b", 40 + i % 50) for i in range(1, 400)] + [(1000 + i, "a", 600) for i in range(1200)] + [(5000, "c", 9_000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    # A weight by which b is wanted with 30,000 words, over one permutation of its small documents.
    total = sum(r[2] for r in rows)
    weights = (5, 30_000 * 5 / (total - 30_000), 1e-9)
    for seed in range(4):
        got = mixing.mixed(sized, F.col("size"), weights, 3, seed).collect()
        assert len(got) == len(rows) and all(len({d["epoch"] for d in r["draws"]}) == len(r["draws"]) <= 3 for r in got)
        want = next(r["target"] for r in got if r["source"] == "b")
        taken = sum(r["size"] * len(r["draws"]) for r in got if r["source"] == "b")
        assert abs(taken - want) <= 45, (seed, want, taken)


def test_mix_draws_some_of_equal_long_rows(spark):
    from perimeter.llm import mixing
    rows = [(1, "b", 30_000)] * 50 + [(2 + i, "a", 100) for i in range(30_000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mixed(sized, F.col("size"), (1, 0.1)).filter("source = 'b'").collect()
    want, taken = got[0]["target"], sum(r["size"] * len(r["draws"]) for r in got)
    assert len(got) == 50 and abs(taken - want) <= 15_000
