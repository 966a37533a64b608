"""Documents to token ids: language ID, near-dedup, source mixing, SentencePiece. Every stage writes its decisions into
the rows it hands on; all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm import language_id, mixing, sentencepiece, similar
from tamis.llm.shared import new_folder, read


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language is found: null ones and those without letters. Mixtures of languages stay."""
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, prefix="__")
    return found.where(F.col("__lang_pred") != "und").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: texts linked by a Jaccard similarity of 0.8 on shingles of five words.

    The one of the least id stays, of several with that id the one whose text has the least hash. Rows without an id sort
    behind all others, by a hash of their text. Rows with one id and other texts are documents of their own.
    """
    spare = F.pmod(F.xxhash64("text"), F.lit(1 << 61)) + F.lit(1 << 61)
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), spare)).withColumn("__hash", F.xxhash64("text"))
    groups = similar.similar_texts(keyed, "__key", "text", shingle=5, least=0.8)
    stays = groups.groupBy("component").agg(F.min(F.struct("__key", "text_hash")).alias("first")).select("first.__key", F.col("first.text_hash").alias("__hash"))
    # Of equal rows of one id and text one goes on; each task keeps one of them before any row moves.
    place = F.row_number().over(Window.partitionBy("__key", "__hash").orderBy(F.xxhash64(*docs.columns)))
    return keyed.withColumn("__place", place).where("__place = 1").join(stays, ["__key", "__hash"], "left_semi").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each copy of a document."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked by decoding."""
    return sentencepiece.encode(docs, ["doc_id", "lang", "source"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language_id", known_language), ("simhash_dedup", one_of_each), ("mixing", mixed_sources), ("sentencepiece", encoded)]

#: Trained models and hashed fingerprints have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = new_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
