"""Relations between documents, authors, topics and references, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import parts_of


def coauthor_edges(doc_authors: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: documents that both are authors of.  ``doc_authors`` is (doc, author)."""
    # Dealt by document once, for the distinct rows and both sides of the join; each pair then by itself.
    x = doc_authors.select("doc", "author")
    x = x.repartition(parts_of(x), "doc")
    a, b = x.distinct().alias("a"), x.distinct().alias("b")
    pairs = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.author") < F.col("b.author"))).select(F.col("a.author").alias("a"), F.col("b.author").alias("b"))
    return pairs.repartition(parts_of(doc_authors.select("doc", "author")), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.a", "e.b", "weight")


def top_coauthors(edges: DataFrame, k: int = 50) -> DataFrame:
    """Heaviest k coauthors of each author, ties by id."""
    w = Window.partitionBy("a").orderBy(F.col("weight").desc(), "b")
    return both_ways(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_coauthors(edges: DataFrame, membership: DataFrame, k: int = 50) -> DataFrame:
    """Coauthors of groups (author, grp): weights summed over members, own members left out."""
    m = membership.select(F.col("author").alias("a"), "grp")
    own = membership.select(F.col("author").alias("b"), "grp")
    total = both_ways(edges).join(m, "a").join(own, ["b", "grp"], "left_anti").groupBy("grp", "b").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy("grp").orderBy(F.col("weight").desc(), "b")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def citation_edges(references: DataFrame) -> DataFrame:
    """(cited_key, ref_id, doc) from references (ref_id, doc, authors); names of fewer than three characters are left out."""
    return references.select("ref_id", "doc", F.explode("authors").alias("name")).where(F.length("name") >= 3).select(T.name_key(F.col("name")).alias("cited_key"), "ref_id", "doc").distinct()


def author_network(author: str, edges: DataFrame, cited: DataFrame | None = None, doc_authors: DataFrame | None = None, limit_coauthors: int = 15, limit_citers: int = 15) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) one hop around an author: coauthors, and authors of documents that cite it."""
    own = edges.where((F.col("a") == author) | (F.col("b") == author))
    co = top_coauthors(own, limit_coauthors).where(F.col("a") == author)
    out = co.select(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), F.lit("coauthor").alias("kind"), "weight")
    if cited is not None and doc_authors is not None:
        who = cited.where(F.col("cited_key") == T.name_key(F.lit(author))).join(doc_authors, "doc").where(F.col("author") != author)
        citing = who.groupBy("author").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.col("weight").desc(), "author").limit(limit_citers)
        out = out.unionByName(citing.select(F.col("author").cast("string").alias("source"), F.lit(author).cast("string").alias("target"), F.lit("cites").alias("kind"), "weight"))
    kind = F.when(F.col("id") == F.lit(author).cast("string"), 0).when(F.col("kind") == "coauthor", 1).otherwise(2)
    nodes = out.select(F.explode(F.array("source", "target")).alias("id"), "kind").groupBy("id").agg(F.min(kind).alias("k"))
    return nodes.select("id", F.element_at(F.array(F.lit("target"), F.lit("coauthor"), F.lit("citer")), F.col("k") + 1).alias("kind")), out


def topic_docs(topics: DataFrame) -> DataFrame:
    """(tag, repo, doc), distinct; tags of fewer than three characters are left out.  ``topics`` is (repo, doc, keyword)."""
    return topics.where(F.length(F.trim("keyword")) >= 3).select(T.tag_key(F.col("keyword")).alias("tag"), "repo", "doc").distinct()


def topic_authors(tags: DataFrame, doc_authors: DataFrame, repo_authors: DataFrame | None = None) -> DataFrame:
    """(tag, author), distinct; with ``repo_authors`` (author) only those of the repository.  ``tags`` (tag, doc) dealt by
    document in ``parts_of`` their tables stay where they are."""
    who = doc_authors.select("doc", "author")
    if repo_authors is not None:  # before the join, whose pairs are many
        who = who.join(repo_authors.select("author").distinct(), "author", "left_semi")
    who = who.repartition(parts_of(tags), "doc").distinct()
    return tags.join(who, "doc").select("tag", "author").distinct()


def author_documents(author_docs: DataFrame, membership: DataFrame) -> DataFrame:
    """Distinct documents of each group over its members, with the later role winning where one document has two."""
    rank = F.when(F.col("role") == "contributor", 2).otherwise(1)
    return author_docs.join(membership, "author").groupBy("grp", "doc").agg(F.max_by("role", rank).alias("role"))


# --------------------------------------------------------------------------- statistics
def statistics(docs: DataFrame, top_n: int = 15) -> DataFrame:
    """One row for all and one per repo: totals, year range and histogram, types by whole words, topics, repositories.

    ``docs`` has repo, file, has_fulltext, reference_count, type, keywords, year.
    """
    total = docs.groupingSets([["repo"], []], "repo").agg(F.count(F.lit(1)).alias("documents"), F.count("file").alias("files"), F.count_if("has_fulltext").alias("fulltexts"), F.coalesce(F.sum("reference_count"), F.lit(0)).alias("reference_total"), F.min(sane_year()).alias("year_min"), F.max(sane_year()).alias("year_max"), F.grouping("repo").alias("is_global"))
    total = total.withColumn("scope", F.when(F.col("is_global") == 1, F.lit("global")).otherwise(F.concat(F.lit("repo:"), "repo"))).drop("repo")

    big = [F.col("n").desc(), F.col("v")]
    for part in (_listed(counts(docs, sane_year()), "years", [F.col("v")]), _listed(counts(docs, T.statistics_type(F.col("type"))), "types", big), _listed(counts(docs, F.col("repo")), "repositories", big), top_topics(docs, top_n)):
        total = total.join(part, "scope", "left")
    return total


def counts(docs: DataFrame, value) -> DataFrame:
    """(scope, v, n): how often each value that isn't null occurs, in all documents and in each repository's."""
    both = docs.select("repo", value.alias("v")).where("v is not null").select(F.explode(F.array(F.lit("global"), F.concat(F.lit("repo:"), "repo"))).alias("scope"), "v")
    return both.groupBy("scope", "v").agg(F.count(F.lit(1)).alias("n"))


def _listed(counted: DataFrame, name: str, order, top_n: int | None = None) -> DataFrame:
    r = counted.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy(*order)))
    if top_n:
        r = r.where(F.col("r") <= top_n)
    return r.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v", "n"))), lambda x: F.struct(x["v"].alias("value"), x["n"].alias("n"))).alias(name))


def topic_counts(docs: DataFrame) -> DataFrame:
    """:func:`counts` of keywords, trimmed, without the generic ones."""
    x = docs.select("repo", F.explode("keywords").alias("v")).select("repo", F.trim("v").alias("v")).where(~F.lower("v").isin(T.GENERIC_TAGS) & (F.col("v") != ""))
    return counts(x, F.col("v"))


def top_topics(docs: DataFrame, top_n: int) -> DataFrame:
    return _listed(topic_counts(docs), "topics", [F.col("n").desc(), F.col("v")], top_n)


def top_researchers(docs: DataFrame, top_n: int = 15) -> DataFrame:
    """(scope, rank, key, name, role, repo, n) of those named most often in documents (repo, doc, creators, contributors), by
    name key; name, role and repository are those of the first sighting in the scope."""
    from .authors import mentions

    m = mentions(docs).withColumn("key", T.name_key(F.col("author"))).where("key <> ''")
    m = m.select("key", "author", "role", "repo", "seq", F.explode(F.array(F.lit("global"), F.concat(F.lit("repo:"), "repo"))).alias("scope"))
    c = m.groupBy("scope", "key").agg(F.min(F.struct("seq", "author", "role", "repo")).alias("f"), F.count(F.lit(1)).alias("n"))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("n").desc(), "key"))).where(F.col("rank") <= top_n)
    return r.select("scope", "rank", "key", F.col("f.author").alias("name"), F.col("f.role").alias("role"), F.col("f.repo").alias("repo"), "n")


def of_scope(statistics: DataFrame, repo: str | None = None) -> DataFrame:
    """The row of a repository, or of all documents for none, blank or ``all``, with ``error``: null, or that there is none."""
    scope = "global" if not repo or not repo.strip() or repo.strip().lower() == "all" else f"repo:{repo.strip()}"
    asked = statistics.sparkSession.createDataFrame([(scope,)], "scope string")
    found = statistics.withColumn("_found", F.lit(True))
    return asked.join(found, "scope", "left").withColumn("error", F.when(F.col("_found").isNull(), F.concat(F.lit("no documents for "), "scope"))).drop("_found")


def sane_year():
    return F.when(F.col("year").between(1950, 2030), F.col("year"))


def raw_profiles(mentions: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Profile per author of mentions (author, seq, role, <list columns>): role of the first sighting, mentions, and for
    each list column the first ``cap`` distinct values in order of sighting."""
    first = mentions.groupBy("author").agg(F.min_by("role", "seq").alias("role"), F.count(F.lit(1)).alias("doc_count"))
    for c, cap in caps.items():
        seen = mentions.where(F.col(c).isNotNull()).groupBy("author", c).agg(F.min("seq").alias("at"))
        kept = seen.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy("at", c))).where(F.col("r") <= cap)
        first = first.join(kept.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c]).alias(f"{c}s")), "author", "left")
    return first


def rollup(profiles: DataFrame, membership: DataFrame) -> DataFrame:
    """Groups (author, grp) of profiles (author, role, doc_count): summed counts; name and role of the largest member."""
    best = F.struct(F.col("doc_count"), F.lit(0))
    return profiles.join(membership, "author").groupBy("grp").agg(F.sum("doc_count").alias("doc_count"), F.max(best)["doc_count"].alias("largest"), F.max_by("role", F.struct("doc_count", "author")).alias("role"), F.min_by("author", F.struct(-F.col("doc_count"), F.col("author"))).alias("leader"), F.array_sort(F.collect_set("author")).alias("raw_names"))
