"""The index of cited references: who cites what, and documents coupled by what they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import search as S


def texts(references: Column) -> Column:
    """Texts of an array of references (structs with text), joined."""
    return F.array_join(F.transform(references, lambda r: T.nz(r["text"])), " \n ")


def reference_index(docs: DataFrame, min_df: int = 5) -> S.Index:
    """Index of documents (key, references array<struct<text, ...>>); one without references isn't in it."""
    return S.build_index(docs.select("key", texts(F.col("references")).alias("text")), "key", T.text_tokens(F.col("text")), S.Bm25(min_df=min_df))


def search_references(docs: DataFrame, index: S.Index, queries: dict[str, str], top: int = 10, offset: int = 0, repo: str | None = None) -> DataFrame:
    """Documents that cite what is asked for: qid, key, score, rank, has_more, title, creator, total_references and the
    first three references.  ``docs`` is (key, repo, title, creator, references)."""
    terms = S.correct_query(S.query_terms(docs.sparkSession, queries, T.text_tokens), index.terms)
    allowed = docs.where(F.col("repo") == repo).select("key") if repo else None
    about = docs.select("key", "repo", "title", "creator", F.size("references").alias("total_references"), F.slice("references", 1, 3).alias("sample_references"))
    return S.top(S.scores(index, terms, allowed), top, offset).join(about, "key").orderBy("qid", "rank")


def similar_by_references(docs: DataFrame, index: S.Index, of: DataFrame, top: int = 10, terms: int = 16) -> DataFrame:
    """Documents coupled with each of ``of`` (key) by the rarest terms of its references, or of its description where it has
    none; itself left out."""
    chosen = docs.join(of.select("key").distinct(), "key", "left_semi")
    text = F.when(F.size("references") > 0, texts(F.col("references"))).otherwise(T.nz(F.col("description")))
    own = chosen.select(F.col("key").cast("string").alias("qid"), F.explode(F.array_distinct(T.text_tokens(text))).alias("term"))
    q = S.informative_terms(index, own, terms).select("qid", "term")
    hits = S.top(S.scores(index, q).where(F.col("qid") != F.col("key").cast("string")), top)
    return hits.join(docs.select("key", "title", "creator", F.size("references").alias("reference_count")), "key").orderBy("qid", "rank")


def document(docs: DataFrame, key: str) -> DataFrame:
    """The document of a key, or no row."""
    return docs.where(F.col("key") == key)


def document_references(docs: DataFrame, key: str, stored: DataFrame | None = None) -> DataFrame:
    """References of a document in their order: those of the table ``stored`` (key, ref_num, ...), or the ones in it."""
    own = document(docs, key).select("key", F.posexplode("references").alias("pos", "r")).select("key", (F.col("pos") + 1).alias("ref_num"), F.col("r.text").alias("text"))
    if stored is None:
        return own.orderBy("ref_num")
    kept = stored.where(F.col("key") == key).select("key", "ref_num", "text")
    return kept.unionByName(own.join(kept.select("key").distinct(), "key", "left_anti")).orderBy("ref_num")
