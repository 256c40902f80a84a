"""A training corpus from documents: four stages, each written to Parquet and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.llm import language_id, near_dedup, packing, pii
from kinolith.llm.shared import free_names, settle, table

WORD_BPE = "word_bpe_49k.json"
#: Bits a byte of letters from which a text counts as in no learned language; plain bytes take 8.
UNEXPLAINED_RATE = 7.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and texts that no learned language explains.

    The latter cost the best language's model over UNEXPLAINED_RATE bits a byte
    of their letters, whatever their length; texts of very few distinct words
    say too little and stay, repeated or not. Where nothing could be learned,
    every text with a letter stays. Null and empty texts have no letter, an
    empty table gives an empty one, very long texts are scored whole, equally
    short codes go to the first language. Repeated rows share a fate; columns
    keep their values, whatever their names.
    """
    name, score, rate = free_names(docs, "lang_pred", "score", "bits_per_byte")
    model = language_id.learn(docs)
    found = language_id.with_language(docs, model, (name, score, rate))
    if model.languages:
        kept = (F.col(name) != language_id.UNKNOWN) & (F.col(rate) <= UNEXPLAINED_RATE)
    else:
        kept = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.where(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate group.

    Rows that repeat both doc_id and text are one document and stay once; rows
    without a doc_id cannot be told apart and all stay. Texts without a word
    are in no group, very long ones are compared whole, an empty table gives an
    empty one.
    """
    found = near_dedup.near_duplicates(docs).where("doc_id is not null")
    kept = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept")
    kept = settle(kept.select("doc_id", "n"), "kept")
    stay = docs.join(kept.where("n = 1").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    if kept.where("n > 1").limit(1).count():
        again = docs.join(kept.where("n > 1").hint("merge"), "doc_id", "left_semi")
        stay = stay.union(again.dropDuplicates(["doc_id", "text"]).select(*docs.columns))
    return stay.union(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars, where there is such a column, follows the text.

    Null texts stay null, with their n_chars; no row is dropped or joined, so
    repeated rows stay alike; very long texts are read whole; where spans
    overlap, the fixed kinds come first.
    """
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        size = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        clean = clean.withColumn("n_chars", size)
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every token into sequences of 2048; one row per piece.

    A null or empty text is its end id alone; repeated rows are documents of
    their own; very long texts are cut into pieces; an empty table gives no rows.
    """
    packed = packing.pack(docs, public_tokenizers.path(WORD_BPE))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses none of the stages over whole tables; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
