"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled text (letters only, lower
case, UTF-8). A text is parsed greedily into the longest phrases that occur in that sample; the fewer
phrases, the closer the language. Phrases are priced at log2 of the sample's length and divided by the letters parsed
(bits per byte), and the language with the least price wins.

The automata are tables (state, byte class) -> next state, with the restart after a failed match built
in, so that numpy walks many texts at once: a text is cut into lanes of `LANE` bytes, all of them
parsed, and a step moves all lanes of all languages. A cut costs at most one phrase per lane and
language.

Sample (documented bound): up to `SAMPLE_DOCS` documents per language, first by hash of the id, and of them
`SAMPLE_BYTES` bytes, fewer if the languages are so many that all tables would exceed `MAX_CELLS` entries.

Cases: a null text or one without letters is `und` with score 0; so is every text if nothing is labelled. Ties go
to the language first in order. Repeated rows are judged each on its own, other columns are ignored and
an empty table gives an empty result. Null labels teach nothing. The score is the runner-up's share of
the two least prices (1/2 to 1; 1 with one language)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_BYTES, MAX_CELLS, LANE = 200, 24_000, 32_000_000, 256
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters, with one space for anything between them."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


def automaton(sample: bytes, classes: np.ndarray, width: int) -> np.ndarray:
    """Table of the suffix automaton of `sample`: entry [state, class] is 2 * width * next + (1 if a phrase starts)."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in classes[np.frombuffer(sample, np.uint8)].tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
        last = cur
    # A failed match starts the next phrase with the same byte. An unknown byte is a phrase, after which one starts
    # anew: that is the last state, where a text begins too.
    restart = np.array([nxt[0].get(c, len(nxt)) for c in range(width)], np.int32)
    table = np.tile(2 * width * restart + 1, (len(nxt) + 1, 1))
    for state, edges in enumerate(nxt):
        for c, to in edges.items():
            table[state, c] = 2 * width * to
    return table


@dataclass
class Model:
    langs: list[str]
    classes: np.ndarray  # byte -> class; class 0 for bytes no sample has
    tables: np.ndarray   # all languages' tables, one below the other
    roots: np.ndarray    # where each language's texts begin
    price: np.ndarray    # bits per phrase

    @staticmethod
    def fit(samples: dict[str, bytes]) -> Model:
        langs = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        classes = np.zeros(256, np.int32)
        classes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        tables, roots, row = [], [], 0
        for lang in langs:
            t = automaton(samples[lang], classes, width)
            tables.append(t + 2 * width * row)
            row += len(t)
            roots.append(width * (row - 1))
        flat = np.vstack(tables).astype(np.int32) if tables else np.zeros((1, width), np.int32)
        return Model(langs, classes, flat, np.array(roots, np.int32),
                     np.array([np.log2(max(2, len(samples[x]))) for x in langs]))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per text and language."""
        data = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        size = np.array([len(t) for t in texts], np.int64)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (np.cumsum(size) - size)[owner] + part * LANE
        left = np.minimum(size[owner] - part * LANE, LANE)
        order = np.argsort(-left, kind="stable")
        begin, left = begin[order], left[order]
        flat = self.tables.reshape(-1)
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        count = np.zeros(state.shape, np.int32)
        alive = np.searchsorted(-left, -np.arange(1, LANE + 1), side="right")
        for t in range(LANE):
            n = alive[t]
            if not n:
                break
            step = flat[state[:, :n] + data[begin[:n] + t]]
            count[:, :n] += step & 1
            state[:, :n] = step >> 1
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner[order], weights=count[k], minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, price per byte and what two phrases cost per byte."""
        plain = [letters(t) if t else b"" for t in texts]
        known = [i for i, t in enumerate(plain) if t and any(map(str.isalpha, texts[i]))]
        lang, score, price, spare = ["und"] * len(texts), *np.zeros((3, len(texts)))
        held: list[int] = []
        weight = 0
        for j, i in enumerate(known):
            held.append(i)
            weight += len(plain[i])
            if self.langs and (weight > 4_000_000 or j + 1 == len(known)):
                bits = self.phrases([plain[x] for x in held]) * self.price
                best = np.argmin(bits, axis=1)
                two = np.sort(bits, axis=1)[:, :2] if len(self.langs) > 1 else np.hstack((0 * bits, bits + 1))
                score[held] = two[:, 1] / (two[:, 0] + two[:, 1])
                size = np.array([len(plain[x]) for x in held])
                price[held], spare[held] = two[:, 0] / size, 2 * self.price[best] / size
                for x, b in zip(held, best):
                    lang[x] = self.langs[b]
                held, weight = [], 0
        return lang, score, price, spare


def fit(labelled: DataFrame, docs_per_lang: int = SAMPLE_DOCS, bytes_per_lang: int = SAMPLE_BYTES) -> Model:
    """Model from the labelled rows (doc_id, text, lang). The sample's ids are found first, so that only its texts move."""
    ranked = (labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
              .select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
              .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("n") <= docs_per_lang))
    ids = [r[0] for r in ranked.select("doc_id").distinct().collect()]
    rows = (labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isin(ids)).select("doc_id", "lang", F.substring("text", 1, bytes_per_lang).alias("text"))
            .collect()) if ids else []
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"] or ""))
    langs = {r["lang"] for r in rows}
    plain: dict[str, list[bytes]] = {lang: [] for lang in langs}
    for r in rows:
        if x := letters(r["text"] or ""):
            plain[r["lang"]].append(x)
    width = 1 + len({c for texts in plain.values() for x in texts for c in x})
    most = min(bytes_per_lang, MAX_CELLS // (2 * width * max(1, len(langs))))
    samples: dict[str, bytes] = {}
    for lang, texts in plain.items():
        # The same share of every document, so that none fills the sample.
        each = max(1, most // max(1, len(texts)))
        spare = most - sum(min(len(x), each) for x in texts)
        parts = []
        for x in texts:
            more = min(spare, max(0, len(x) - each))
            parts.append(x[: each + more])
            spare -= more
        if parts:
            samples[lang] = b" ".join(parts)[:most]
    return Model.fit(samples)


def predictor(docs: DataFrame, model: Model, text: Column) -> Column:
    """Column (lang, score, price, spare) of a text column, with the model broadcast: at most MAX_CELLS ints.

    It is marked as not deterministic, which it is, so that a filter on it is not given a call of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, price double, spare double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(dict(zip(("lang", "score", "price", "spare"), shared.value.predict(texts.tolist()))))
    return run.asNondeterministic()(text)
