"""The corpus pipeline: five stages over documents, each written as Parquet and reread.
An empty table passes through all of them.

Language ID rejects documents; the n-gram join keeps one document of each group; personal
data is replaced; sources are mixed to target weights, repeating documents; the texts that
are left are encoded. Further columns of documents pass through, whatever their names; only
names that begin with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import pii
from corpuslens.llm.common import fresh_path, table, tokenizer, written
from corpuslens.llm.language_id import identify, learn
from corpuslens.llm.ngram_join import SENT_ROWS, near_components
from corpuslens.llm.sentencepiece_codec import encode
from corpuslens.llm.source_mix import mix_sources, repeat_documents

#: A text with so many letters and a smaller cosine with its nearest language is none: it
#: repeats a few words or fragments. Running text of that length has 0.6 and more.
LETTERS, LEAST_SCORE = 256, 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; unlabelled ones get the one predicted.

    Null and empty texts, those without a letter, and those of ``LETTERS`` letters and more
    whose score is below ``LEAST_SCORE`` go. Where there is nothing to learn from, every
    text with a letter stays. Repeated rows are judged alike; very long texts whole.
    """
    prototypes = learn(docs)
    found = identify(docs, prototypes, keep=tuple(docs.columns), lang_as="__lang", score_as="__score")
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    if not prototypes:
        return found.filter(letters > 0).select(docs.columns)
    kept = found.filter((F.col("__lang") != "und") & ((F.col("__score") >= LEAST_SCORE) | (letters < LETTERS)))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; empty texts stay apart.

    A group's document is the one with the smallest id; of rows that share that id inside
    the group, one stays. Rows that share an id but not a group are different documents and
    stay, and so do rows without an id, which no group can name.
    """
    row = "__row"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = written(near_components(numbered, keep=(row,)).filter("doc_id IS NOT NULL"), "groups")
    first = groups.filter("doc_id = component_id").groupBy("component_id", "group_id", F.when(F.col("n_shingles") == 0, F.col(row)).alias("__empty")).agg(F.min(row).alias(row))
    gone = written(groups.select(row).join(first.select(row), row, "left_anti"), "gone")
    gone = F.broadcast(gone) if gone.count() <= SENT_ROWS else gone  # the texts stay where they are
    return numbered.join(gone, row, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by marks; null, empty and clean texts stay
    as they are, repeated rows are treated alike, very long texts whole."""
    found = pii.find_spans(docs, pii.train(docs), base_as="__base", spans_as="__spans")
    text = pii.redact(F.col("text"), F.col("__spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null and empty texts have size 0 and are
    taken as often as their source is repeated whole. Ties and repeated rows: see
    :mod:`corpuslens.llm.source_mix`."""
    return repeat_documents(docs, mix_sources(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every document, repeats included; null and empty
    texts have no ids; very long texts are encoded whole."""
    return encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("language ID", language), ("n-gram join", near_duplicates), ("personal data", personal_data), ("source mix", mixing), ("SentencePiece", encoding)]

#: Learned models and tokenizer ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
