"""Quality rules with thresholds that follow the corpus (DataFrame functions only).

Every document gets a few integer measures. Their distributions per language and source are kept as
quantile sketches: counts per logarithmic bucket, as in DDSketch, with 32 buckets per power of two, so
a quantile is off by 3 % at most. Sketches merge by adding counts, before the shuffle as
well as up the hierarchy: a source with few documents uses its language's sketch, a small language that
of the corpus. A document is out if a measure lies beyond the fences around the middle half of its
group: quartile -/+ `reach` times the interquartile range (or a least range, where documents agree).

Cases: a null text has no words and fails the base rules. Null languages and sources form groups of
their own. Rows are judged each on its own, repeated or not. Other columns are ignored; an empty table
gives an empty result. Thresholds come only from documents that pass the base rules; the corpus-wide
sketch serves however few they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimeter.llm.common import INK, WHITE, words
from perimeter.storage import materialize

SYMBOLS = "#*$%&|<>"
#: Measures per mille: (name, lower fence too, least interquartile range)
MEASURES = (("word_length", True, 300), ("symbols", False, 60), ("dup_lines", False, 150), ("repeats", False, 150))
REACH, LEAST_DOCUMENTS = 3, 100


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(INK))
    w = F.col("_w")
    out = (docs.select("doc_id", "lang", "source", words(F.col("text")).alias("_w"), lines.alias("_l"),
                       F.length(F.regexp_replace(text, WHITE, "")).cast("long").alias("word_chars"),
                       F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"))
           .withColumn("n_lines", F.size("_l").cast("long"))
           .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_l")))
           .withColumn("n_words", F.size(w).cast("long"))
           .withColumn("_h", F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
               F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
                   F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))).drop("_w", "_l"))
    # Only texts in which a window comes twice are sorted: equal windows become neighbours.
    h, s, p = F.col("_h"), F.col("_s"), F.col("_p")
    return (out.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(
                F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
            .withColumn("_p", F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(
                F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"])))
            .withColumn("n_repeat_words", F.coalesce(F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
            .drop("_h", "_s", "_p"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bucket(x: Column) -> Column:
    """Lower edge of the sketch's bucket: exact below 64, then 32 buckets per power of two."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def _measures() -> list[Column]:
    n, rows = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    values = {"word_length": F.col("word_chars"), "symbols": F.col("n_symbols"), "repeats": F.col("n_repeat_words")}
    return [F.floor((1000 * F.col("n_dup_lines") / rows) if m == "dup_lines" else 1000 * values[m] / n).cast("long").alias(m)
            for m, _, _ in MEASURES]


def thresholds(measured: DataFrame, reach: int = REACH, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source and the fences <measure>_low and <measure>_high, from documents that passed the base rules."""
    long = measured.filter(~F.col("base_failed")).select("lang", "source", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("edge")) for m, _, _ in MEASURES])))
    sketch = materialize(long.groupBy("lang", "source", "measure", "edge").agg(F.count("*").alias("n")))
    merged = (sketch.groupingSets([["lang", "source", "measure", "edge"], ["lang", "measure", "edge"], ["measure", "edge"]],
                                  "lang", "source", "measure", "edge")
              .agg(F.sum("n").alias("n"), F.grouping_id().alias("level")))
    group = ["level", "lang", "source", "measure"]
    upto = Window.partitionBy(*group).orderBy("edge")
    run = merged.select(*group, "edge", F.sum("n").over(upto).alias("upto"),
                        F.sum("n").over(Window.partitionBy(*group)).alias("total"))
    first = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("edge")))
    quartiles = run.groupBy(*group).agg(F.max("total").alias("total"), first(1).alias("q1"), first(3).alias("q3"))
    wide = []
    for m, low, floor in MEASURES:
        spread = reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(floor))
        here = F.col("measure") == m
        wide.append(F.max(F.when(here, F.col("q3") + spread)).alias(f"{m}_high"))
        if low:
            wide.append(F.max(F.when(here, F.col("q1") - spread)).alias(f"{m}_low"))
    fences = materialize(quartiles.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *wide))
    bounds = [c for c in fences.columns if c.endswith(("_low", "_high"))]
    pick = lambda level, name: fences.filter(f"level = {level}").select(
        F.col("lang").alias("_lang"), F.struct("total", *bounds).alias(name))
    own = fences.filter("level = 0").select("lang", "source", F.struct("total", *bounds).alias("own"))
    tongue, whole = pick(4, "tongue"), pick(12, "whole").drop("_lang")
    every = measured.select("lang", "source").distinct()
    own = every.join(own, every["lang"].eqNullSafe(own["lang"]) & every["source"].eqNullSafe(own["source"]), "left").select(
        every["lang"], every["source"], "own")
    chosen = (own.join(tongue, own["lang"].eqNullSafe(F.col("_lang")), "left")
              .select("lang", "source", "own", "tongue", whole.scalar().alias("whole")))
    enough = lambda c: F.when(F.col(f"{c}.total") >= least, F.col(c))
    return chosen.select("lang", "source", F.coalesce(enough("own"), enough("tongue"), F.col("whole")).alias("f")).select(
        "lang", "source", *[F.col(f"f.{b}").alias(b) for b in bounds])


def judge(docs: DataFrame, reach: int = REACH, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Counts, base_failed and kept of every row of `docs` (doc_id, text, lang, source)."""
    measured = features(docs).withColumn("base_failed", base_failed())
    measured = materialize(measured.select("*", *_measures()))
    fences = thresholds(measured, reach, least).withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    within = F.lit(True)
    for m, low, _ in MEASURES:
        within = within & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if low:
            within = within & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    joined = measured.join(fences, measured["lang"].eqNullSafe(fences["_lang"])
                           & measured["source"].eqNullSafe(fences["_source"]), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & within).alias("kept"))
