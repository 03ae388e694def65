"""Author profiles, raw and of groups, and the searches over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import search as S

# Roles, and how many values a profile keeps.
ROLES = ("Autor", "Colaborador / Asesor")
RAW_CAPS = {"keywords": 20, "coauthors": 15, "topic_texts": 10, "cited_references": 30}
GROUP_CAPS = {"keywords": 40, "coauthors": 15, "topic_texts": 10, "cited_references": 30}
NONE = "cast(array() as array<string>)"


def name_tokens(c: Column) -> Column:
    """Tokens of names: lower case, no accents, no punctuation."""
    return T.text_tokens(c, accents=False)


def mentions(docs: DataFrame) -> DataFrame:
    """(author, role, repo, doc, seq, place) of documents (repo, doc, creators, contributors): creators before contributors;
    ``seq`` is a struct in the order of the documents' keys."""

    def part(c: str, rank: int) -> Column:
        return F.transform(F.coalesce(c, F.expr(NONE)), lambda x, i: F.struct(x.alias("author"), F.lit(ROLES[rank]).alias("role"), F.lit(rank).alias("rank"), i.alias("place")))

    x = docs.select("repo", "doc", F.explode(F.concat(part("creators", 0), part("contributors", 1))).alias("m")).where("m.author is not null")
    return x.select("m.author", "m.role", "repo", "doc", F.struct("repo", "doc", "m.rank", "m.place").alias("seq"))


def _first(values: DataFrame, key: str, name: str, cap: int) -> DataFrame:
    """(key, name): the first ``cap`` distinct values of (key, seq, value) in order of sighting."""
    seen = values.where(F.trim("value") != "").groupBy(key, "value").agg(F.min("seq").alias("at"))
    kept = seen.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("at", "value"))).where(F.col("r") <= cap)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias(name))


def raw_profiles(docs: DataFrame) -> DataFrame:
    """Profile of each exact name in documents (repo, doc, creators, contributors, keywords, description, references
    array<string>): name, role of the first sighting, doc_count (mentions), doc_ids, repos, and capped lists."""
    m = mentions(docs)
    out = m.groupBy(F.col("author").alias("name")).agg(F.min_by("role", "seq").alias("role"), F.count(F.lit(1)).alias("doc_count"), F.array_sort(F.collect_set(T.doc_key(F.col("repo"), F.col("doc")))).alias("doc_ids"), F.array_sort(F.collect_set("repo")).alias("repos"))
    key = ["repo", "doc"]
    lists = {"keywords": F.col("keywords"), "topic_texts": F.array(T.nz(F.col("description"))), "cited_references": F.col("references"), "coauthors": F.col("creators")}
    for name, values in lists.items():
        x = m.join(docs.select(*key, F.posexplode(values).alias("pos", "value")), key)
        if name == "coauthors":
            x = x.where("value <> author")
        x = x.select(F.col("author").alias("name"), F.struct("seq", "pos").alias("seq"), "value")
        out = out.join(_first(x, "name", name, RAW_CAPS[name]), "name", "left")
    return out.select(*[c for c in out.columns if c not in RAW_CAPS], *[F.coalesce(c, F.expr(NONE)).alias(c) for c in RAW_CAPS])


def roll_up(profiles: DataFrame, membership: DataFrame) -> DataFrame:
    """Groups (name, consolidated_id) of raw profiles: summed counts, name and role of the largest member (the smaller name
    of equals), sorted unions, and lists in the members' order, capped."""
    x = profiles.join(membership.select("name", "consolidated_id"), "name")
    order = F.struct(-F.col("doc_count"), F.col("name"))
    out = x.groupBy("consolidated_id").agg(
        F.min_by("name", order).alias("name"), F.min_by("role", order).alias("role"), F.sum("doc_count").alias("doc_count"), F.array_sort(F.collect_set("name")).alias("raw_names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("repos")))).alias("repos"),
    )
    for name, cap in GROUP_CAPS.items():
        values = x.select("consolidated_id", order.alias("o"), F.posexplode(name).alias("pos", "value")).select("consolidated_id", F.struct("o", "pos").alias("seq"), "value")
        out = out.join(_first(values, "consolidated_id", name, cap), "consolidated_id", "left")
    out = out.select(*[c for c in out.columns if c not in GROUP_CAPS], *[F.coalesce(c, F.expr(NONE)).alias(c) for c in GROUP_CAPS])
    return out.withColumn("name_initials_form", T.initials_form(T.name_swap(F.col("name"))))


def name_text(name: Column) -> Column:
    """What the name index holds of an author: the name and its form with initials."""
    return F.concat_ws(" . ", name, T.initials_form(T.name_swap(name)))


def profile_text(name: Column, keywords: Column, topics: Column, references: Column) -> Column:
    part = lambda c, sep: F.array_join(F.coalesce(c, F.expr(NONE)), sep)
    return F.concat_ws(" . ", name, part(keywords, " , "), part(topics, " \n "), part(references, " \n "))


def name_index(authors: DataFrame) -> S.Index:
    return S.build_index(authors.select(F.col("consolidated_id").alias("key"), name_text(F.col("name")).alias("text")), "key", name_tokens(F.col("text")))


def profile_index(authors: DataFrame, min_df: int = 3) -> S.Index:
    text = profile_text(*(F.col(c) for c in ("name", "keywords", "topic_texts", "cited_references")))
    return S.build_index(authors.select(F.col("consolidated_id").alias("key"), text.alias("text")), "key", T.text_tokens(F.col("text")), S.Bm25(min_df=min_df))


def _of_repo(authors: DataFrame, repo: str | None) -> DataFrame | None:
    return authors.where(F.array_contains("repos", repo)).select(F.col("consolidated_id").alias("key")) if repo else None


ABOUT = ("name", "role", "doc_count", "repos", "coauthors", "keywords")


def _described(hits: DataFrame, authors: DataFrame) -> DataFrame:
    about = authors.select(F.col("consolidated_id").alias("key"), *ABOUT)
    return hits.join(about, "key").withColumnRenamed("key", "consolidated_id").orderBy("qid", "rank")


def search_authors(authors: DataFrame, index: S.Index, queries: dict[str, str], top: int = 10, offset: int = 0, repo: str | None = None) -> DataFrame:
    """Authors by name: qid, consolidated_id, score, rank, has_more and what the profile says.  A repository limits which
    authors are returned, never their scores; words are searched in the form that the index has."""
    terms = S.correct_query(S.query_terms(authors.sparkSession, queries, name_tokens), index.terms)
    return _described(S.top(S.scores(index, terms, _of_repo(authors, repo)), top, offset), authors)


def resolve(authors: DataFrame, index: S.Index, references: dict[str, str]) -> DataFrame:
    """(qid, consolidated_id) of each reference to an author: by id, else by a raw name's key, else the best hit by name."""
    spark = authors.sparkSession
    refs = spark.createDataFrame(list(references.items()), "qid string, ref string")
    by_id = refs.join(authors.select(F.col("consolidated_id").alias("ref"), "consolidated_id"), "ref").select("qid", F.lit(0).alias("tier"), "consolidated_id")
    keys = authors.select("consolidated_id", F.explode("raw_names").alias("raw")).select(T.name_key(F.col("raw")).alias("k"), "consolidated_id")
    by_name = refs.withColumn("k", T.name_key(F.col("ref"))).join(keys, "k").select("qid", F.lit(1).alias("tier"), "consolidated_id")
    best = search_authors(authors, index, references, 1).select("qid", F.lit(2).alias("tier"), "consolidated_id")
    return by_id.unionByName(by_name).unionByName(best).groupBy("qid").agg(F.min(F.struct("tier", "consolidated_id"))["consolidated_id"].alias("consolidated_id"))


def similar_authors(authors: DataFrame, index: S.Index, of: DataFrame, top: int = 10, terms: int = 16, repo: str | None = None) -> DataFrame:
    """Authors like each of ``of`` (consolidated_id), itself left out, by the rarest terms of its profile."""
    own = index.postings.join(of.select(F.col("consolidated_id").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("qid"), "term")
    q = S.informative_terms(index, own, terms).select("qid", "term")
    return _described(S.top(S.scores(index, q, _of_repo(authors, repo)).where("qid <> key"), top), authors)
