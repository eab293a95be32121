"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Every stage works on all documents that its predecessor kept, and all but the last return the columns of documents.
Further columns travel inside a struct, so they pass unharmed whatever their names. Rules for odd rows: documents with a null text
or without a letter are rejected by the first stage; rows that repeat a doc_id stay or go together in the third stage, and
rows with a null doc_id stay there, since no result can name them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from randaudit.llm import decontam, jaccard, langid, linededup, packing
from randaudit.llm.common import shared_dir, table

_REST = "rest"


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and one struct of all other columns, named by their places."""
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("row"), *others).alias(_REST))


def _restored(carried: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again; those named in `changed` by their new values."""
    old = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"{_REST}.c{k}") for k, c in enumerate(docs.columns)}
    return carried.select(*[changed.get(c, v).alias(c) for c, v in old.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those with a null text or without a letter go, also if no label was there to learn from."""
    model = langid.fit(langid.learnable(docs))
    if not model["langs"]:
        return _restored(langid.lettered(_carried(docs)), docs)
    told = langid.predict(_carried(docs), model)
    return _restored(told.where(F.col("lang_pred") != langid.UNKNOWN), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that the line rule drops; n_chars follows the text."""
    clean = linededup.cleaned(_carried(docs), linededup.first_state(docs))
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return _restored(clean, docs, text=text, n_chars=F.length(text).cast("long"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that with the smallest doc_id."""
    first = jaccard.join(docs).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("first_id")).distinct()
    carried = _carried(docs)
    judged = carried.join(first, F.col("doc_id") == F.col("first_id"), "left_semi")
    return _restored(judged.unionByName(carried.where(F.col("doc_id").isNull())), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontam.hits(_carried(docs), table(spark, sf_dir, "benchmark"), keep=(_REST,))
    return _restored(decontam.judged(found).where(~F.col("contaminated")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the tokenizer and the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's rows stored in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
