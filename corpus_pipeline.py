"""A training corpus in five stages, each on all that the stage before it kept.

language ID -> line dedup -> MinHash near-dedup -> benchmark decontamination -> BPE.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm import bpe, decontam, langid, linededup, minhash
from folioforge.llm.common import save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: doc_id, or for a null one a number from 2^62 on by the text's hash."""
    stand_in = F.pmod(F.xxhash64("text"), F.lit(1 << 62)) + F.lit(1 << 62)
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), stand_in))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: null or empty text, no letters, or far from every centroid.

    Rows are judged by their whole text alone: repeated ones all go or all stay, a null doc_id doesn't matter, a null lang
    is not learned from; an empty table gives none; columns beside those of documents are dropped."""
    model = langid.train(docs)
    return langid.identify(docs.select(*COLUMNS), model).where(~F.col("lang_rejected")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source; a document that is nothing else is left for the next stage, and near
    copies don't make their own lines boilerplate.

    Every row stays, repeated ones too; null text stays null; a null source is a source; n_chars is that of the text
    that is left, null for null."""
    out = linededup.drop_boilerplate(docs.select(*COLUMNS), whole_pages="keep", copies="fold")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, 0.8): of the smallest doc_id.

    Rows with one doc_id are one document, of which one row stays, the first by hash and text; rows without doc_id take
    part by their text, and stay only where no document with one is near; texts without words (null, empty) link with
    nothing.  Ties can't occur, an empty table gives none, and whole texts are compared."""
    docs = _keyed(docs.select(*COLUMNS))
    found = minhash.near_duplicates(docs.select(F.col("_key").alias("doc_id"), "text"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_key")).distinct()
    left = docs.join(gone, "_key", "left_anti")
    again = save(left.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"), "repeated")
    first = Window.partitionBy("_key").orderBy(F.xxhash64("text"), "text", F.col("doc_id").isNull(), "source", "lang")
    # A repeated row's text waits for its turn by hash: of equal hashes and rows, one is as good as another.
    repeated = left.join(again, "_key", "left_semi").dropDuplicates(["_key", "text", "source", "lang"]).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return left.join(again, "_key", "left_anti").unionByName(repeated).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a window of any benchmark item; every row is judged by its own whole text.

    Repeated rows all go or all stay, a null doc_id doesn't matter, null text holds nothing, an empty benchmark drops
    nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = _keyed(docs.select(*COLUMNS)).withColumn("_text", F.xxhash64("text"))
    found = decontam.contamination(docs.select(F.col("_key").alias("doc_id"), "text", "_text"), benchmark, min_items=1, carry=("_text",))
    gone = found.where("contaminated").select(F.col("doc_id").alias("_key"), "_text").distinct()
    return docs.join(gone, ["_key", "_text"], "left_anti").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each row that is left, as :func:`folioforge.llm.bpe.token_digests` gives them."""
    return bpe.token_digests(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The stages rest on a trained classifier, hashing and a tokenizer file, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
