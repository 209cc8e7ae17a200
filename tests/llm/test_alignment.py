"""Cross-tokenizer alignment against a brute-force version over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from perimeter.llm import alignment, queries
from perimeter.llm.alignment import TOKENIZERS

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "a", "  \n\t\n\n  x", "Ünïcödé – 東京 🎉 tabs\tand\r\nlines", "<|endoftext|> <s> </s> <0x0A> ▁ ▁x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
       "-" * 700, " " * 3000 + "end", "naïve space wide ́", "x" * 20_000, "1234567890 1,000.00 $#@!", "a\u0000b", "﻿bom", "the cat sat on the mat"] * 2


def brute(texts):
    """Groups by comparing every prefix of the joined tokens, with the plain tokenizer library."""
    a_lib = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a_lib.encode_special_tokens = True
    b_lib, of = alignment.Pieces(f"{TOKENIZERS}/piece_bpe_32k.model"), alignment.byte_table()
    out, links = [], []
    for t in texts:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode([t])[0] if t else []
        spelled = [bytes(of[c] for c in a_lib.id_to_token(i)) for i in a]
        if not t or not b"".join(spelled) == (" " + t).encode() == b"".join(b_lib.bytes[i] for i in b):
            out.append([])
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in spelled]).tolist(), np.cumsum([len(b_lib.bytes[i]) for i in b]).tolist()]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            n, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:n], b[j:m]))
            i, j = n, m
        found, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            found.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        out.append(groups)
        links.append(found)
    return out, links


def expected(texts):
    groups, links = brute(texts)
    count = Counter(p for x in links for p in x)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for g, found in zip(groups, links):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(found), sum(count[p] == most[p[1]] for p in found),
                     sum(count[p] for p in found), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return rows


def figures(df):
    return df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()


def test_whole_table(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want = {i: (i, *w) for (i, _), w in zip(docs, expected([t for _, t in docs]))}
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op11_tokenizer_alignment"](spark, SF).collect()}
    assert got == want


def test_odd_texts_chunks_and_columns(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_DOCS", 2)
    monkeypatch.setattr(alignment, "CHUNK_DOCS", 4)
    rows = [(None if i % 7 == 3 else i % 11, t, 1, 2, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair int, chunk string").repartition(3)
    want = Counter((r[0], *w) for r, w in zip(rows, expected(ODD)))
    assert Counter(map(tuple, figures(alignment.align_and_count(docs)))) == want
    assert alignment.align_and_count(docs.limit(0)).count() == 0
    spelled = alignment.align(docs.filter("text LIKE 'the cat%'")).collect()
    assert len(spelled) == 2 and all(r["groups"] and all(g["a"] and g["b"] for g in r["groups"]) for r in spelled)


@pytest.mark.parametrize("seed", range(5))
def test_cuts_of_random_ends(seed):
    rng = np.random.default_rng(seed)
    ends, first, base = ([], []), ([0], [0]), 0
    for _ in range(50):
        size = int(rng.integers(1, 200))
        for side in (0, 1):
            keep = rng.random(size - 1) < rng.choice([0.02, 0.3, 0.9])
            ends[side].extend([base + 1 + int(x) for x in np.flatnonzero(keep)] + [base + size])
            first[side].append(len(ends[side]))
        base += size
    a, b = (np.array(x) for x in ends)
    cut_a, cut_b = alignment.shared_cuts(a, b, *(np.array(f) for f in first))
    both = np.intersect1d(a, b)
    assert np.array_equal(a[cut_a - 1], both) and np.array_equal(b[cut_b - 1], both)
