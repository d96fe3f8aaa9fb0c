"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of ``documents``.

Cases: a null text and one without a letter have no language and go in the first stage; null doc_ids,
null sources and null lang take part like any others (a null source is a source of its own); of rows
that repeat in doc_id and text one stays; of equal texts and of near copies the row with the least
doc_id stays, nulls last; whole texts of any length count; an empty table gives an empty table; further
columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import exact_dedup, jaccard_join, language, mixing, packing, shared

#: Documents of the mix whose pieces may share a sequence.
WINDOW_ROWS = 8192


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; ``lang`` becomes the predicted one."""
    model = language.fit(docs.where(~language.held_out(docs)))
    columns = [c for c in docs.columns if c != "doc_id"]
    found = language.predict(docs, model, carry=columns).where("NOT rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over 5-word shingles one stays."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule to the target weights, files and rows in order."""
    rows = docs.select("source", "doc_id", "text", F.struct("*").alias("_docs"))
    mixed = mixing.mix(rows, carry=["_docs"])
    return mixed.repartitionByRange("slot", "source_rank").sortWithinPartitions("slot", "source_rank").select("_docs.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 1024 tokens.

    A window is ``WINDOW_ROWS`` documents in the order of the mix (files by number, rows by place). Sequences go up with windows and never mix
    them, so the mix holds at that grain. Docs that aren't read from files have no such order and are one window.
    """
    try:
        docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        docs = docs.select("doc_id", "text", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_row"))
    number = F.coalesce(F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("int"), F.lit(0))
    window = number * 256 + F.least(F.expr(f"_row div {WINDOW_ROWS}"), F.lit(255)).cast("int")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), window=window))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("pfair_mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express centroids, schedules or packing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
