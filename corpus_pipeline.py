"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the columns of documents (null texts and ids, repeated rows and other columns are as told there);
the last returns the pieces of the packed sequences. A stage's result is written as Parquet and read
again as the next one's documents. Near duplicates are documents that share at least 0.75 of their five-word shingles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidcheck.llm import common, decontaminate, language, neardup, packing, substrings

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever else comes along."""
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in (f.split(" ") for f in DOCUMENTS.split(", "))])


def _own(docs: DataFrame) -> DataFrame:
    """docs with `_own`, the doc_id or, where there is none, a hash of the text, by which a stage's decisions find their documents."""
    return docs.withColumn("_own", F.coalesce("doc_id", F.xxhash64(F.lit("no id"), "text")))


def _by_own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("_own").alias("doc_id"), "text")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or far from all languages for their length, go. Learned from all labelled documents."""
    docs = _documents(docs)
    return language.identified_only(docs, language.fit(docs.select("doc_id", "text", "lang")))


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates; rows that repeat an id come through once. Documents without id count as any others, by a hash of their text."""
    docs = _own(_documents(docs))
    kept = neardup.near_duplicates(_by_own(docs)).where("kept").select(F.col("doc_id").alias("_own")).distinct()
    return docs.join(kept, "_own", "left_semi").dropDuplicates(["_own"]).drop("_own")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur again anywhere, and without strings of 400 bytes that do and hold too few words to be such; parts of a character that a cut leaves go too.

    Words part at ASCII white space, which may differ between occurrences.

    A document of which only white space is left goes; one that had nothing else before stays.
    """
    docs = _documents(docs)

    @common.lean
    def run(batches):
        for pdf in batches:
            texts, keep = [], []
            for text, spans, words in zip(pdf["text"].tolist(), pdf["spans"].tolist(), pdf["words"].tolist()):
                raw = substrings.text_bytes(text)
                raw, removed, _ = substrings.cut(raw, [*(() if spans is None else spans), *substrings.byte_spans(raw, words)])
                new = raw.decode("utf-8", "ignore") if removed else text
                texts.append(new)
                keep.append(not removed or bool(new.strip()))
            out = pdf.drop(columns=["spans", "words"]).assign(text=texts)
            sizes = pd.array([None if t is None else len(t) for t in texts], dtype="Int64")
            yield out.assign(n_chars=sizes)[pd.Series(keep, index=out.index, dtype=bool)]

    found = substrings.without_repeats(docs, common.shared_dir(spark), {"words": substrings.WORDS, "spans": substrings.WORDLESS})
    found = common.identified(found, "lang", "source", F.lit(0).alias("n_chars"), "spans", "words")
    return found.mapInPandas(run, DOCUMENTS).withColumn("doc_id", common.id_or_null())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = _own(_documents(docs))
    found = decontaminate.leaks(_by_own(docs), common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_own")).distinct()
    return docs.join(found, "_own", "left_anti").drop("_own")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", keep_first_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Similarity, alignment of repeats and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on documents. What a stage has written for itself goes when its result is written, and that when the next one's is."""
    docs, folder, before = common.table(spark, sf_dir, "documents"), common.shared_dir(spark), None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), folder, name)
        if before:
            common.discard(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
