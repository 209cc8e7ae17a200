"""Training-data pipeline: language ID, line dedup, near-dedup, mixing and packing over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next
one's docs. All but the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables
are handled as the operators' docstrings say."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimeter.llm import language, mixing, neardup, packing
from perimeter.llm.common import remainder, word_count
from perimeter.llm.line_dedup import line_dedup
from perimeter.storage import checkpoint_root, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words in a bin of the last stage.
CAPACITY = 2048
#: Bound of the language stage: so many times the median, from so many labelled documents.
FAR, LEAST_LABELLED = 2.75, 30


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the present text."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the prediction into `lang` and drops documents of no language.

    These are texts without a letter, and texts whose price per byte, less two phrases (which short texts can owe to
    their ends), is over `FAR` times the median of the labelled documents of that language (junk among them does not move it). It is over those the
    model has not seen; with fewer than `LEAST_LABELLED` of them a language has no bound.
    Junk that is labelled and drawn into a language's sample teaches it and can pass."""
    model = language.fit(docs.filter(remainder("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    told = materialize(docs.select(*COLUMNS, language.predictor(docs, model, F.col("text")).alias("_p")).filter("_p.lang <> 'und'"))
    unseen = told.filter((remainder("doc_id", 3) == 1) & (F.col("lang") == F.col("_p.lang")))
    bounds = unseen.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("_p.price", 0.5, 10_000).alias("q")).collect()
    most = {r["lang"]: FAR * r["q"] for r in bounds if r["n"] >= LEAST_LABELLED}
    kept = told.withColumn("lang", F.col("_p.lang"))
    for lang, bound in sorted(most.items()):
        kept = kept.filter((F.col("lang") != lang) | (F.col("_p.price") - F.col("_p.spare") <= bound))
    return kept.select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that repeat in windows of three; the documents stay."""
    return _documents(line_dedup(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (sets of 5-word shingles, Jaccard 0.8 or more): the one of least id."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix draws them: some not at all, some up to three times."""
    return mixing.mix(docs.select(*COLUMNS), word_count(F.col("text"))).select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the bin of each."""
    return packing.pack(docs, word_count(F.col("text")), packing.text_cluster(F.col("text")), CAPACITY)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("simhash_near_dedup", near_dedup),
          ("mixing", mix_sources), ("best_fit_packing", pack_bins)]
#: Fingerprints, automata and best fit have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_root(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
