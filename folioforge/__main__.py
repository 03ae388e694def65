"""Command line: ``python -m folioforge COMMAND``.  Results are JSON lines; errors go to stderr with exit code 1."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import authors as A
from .operators import graph as G
from .operators import people as P
from .operators import references as C
from .operators import search as S
from .plans.shared import forget_older, save
from .sources import records as R


FOUND = ("authors", "similar-authors", "references", "similar-references", "document", "document-references", "stats")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioforge", description="Search and mining of harvested records.")
    p.add_argument("--data", default="data", help="folder of repo=<name>/metadata.jsonl")
    p.add_argument("--index", default="index", help="folder of the documents, the index and the statistics")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("build-corpus", help="documents from harvested records")
    sub.add_parser("index", help="index and statistics of the documents")
    sub.add_parser("prepare-index", help="build-corpus, then index")
    sub.add_parser("status", help="records of each repository")
    sub.add_parser("info", help="statistics of all documents and of each repository")
    c = sub.add_parser("search", help="ranked documents")
    c.add_argument("q")
    c.add_argument("--repo")
    c.add_argument("--keyword")
    c.add_argument("--type", dest="doc_type")
    c.add_argument("--year-min", type=int)
    c.add_argument("--year-max", type=int)
    c.add_argument("--top", "-k", type=int, default=10)
    c.add_argument("--offset", type=int, default=0)
    c = sub.add_parser("similar", help="documents like one document")
    c.add_argument("key", help="repo:id")
    c.add_argument("--top", "-k", type=int, default=10)
    c = sub.add_parser("harvest", help="append new records of repositories")
    c.add_argument("--repos", required=True, help="JSON file of name: endpoint")
    c.add_argument("--full", action="store_true", help="from the beginning, not from the last harvest")
    c = sub.add_parser("consolidate-authors", help="groups of names, their ids and profiles, and the author indices")
    c.add_argument("--overrides", help="TOML file of merge, split and impute groups")
    for name, what, ref in (("authors", "authors by name", "q"), ("similar-authors", "authors like one", "author"), ("references", "documents that cite", "q"), ("similar-references", "documents that cite alike", "key")):
        c = sub.add_parser(name, help=what)
        c.add_argument(ref)
        c.add_argument("--repo")
        c.add_argument("--top", "-k", type=int, default=10)
        c.add_argument("--offset", type=int, default=0)
    for name, what in (("document", "one document"), ("document-references", "what it cites")):
        sub.add_parser(name, help=what).add_argument("key", help="repo:id")
    sub.add_parser("stats", help="statistics of a repository, or of all").add_argument("--repo")
    c = sub.add_parser("clean", help="delete intermediate tables in the shared folder")
    c.add_argument("--days", type=float, default=7, help="age; more than the longest run")
    return p


def build_corpus(spark: SparkSession, data: str, index: str) -> None:
    raw = R.records(spark, data).where("id is not null and repo is not null")
    R.replace_table(R.build_corpus(raw), f"{index}/documents")


def build_index(spark: SparkSession, index: str) -> None:
    docs = spark.read.parquet(f"{index}/documents")
    text = T.index_text(*(F.col(c) for c in ("title", "creators", "contributors", "keywords", "description", "conclusions")))
    keyed = docs.select(T.doc_key(F.col("repo"), F.col("id")).alias("key"), text.alias("text"))
    staging = f"{index}/search.new-{uuid.uuid4().hex}"
    S.build_index(keyed, "key", T.text_tokens(F.col("text"))).write(staging)
    R.replace_dir(spark, staging, f"{index}/search")
    R.replace_table(G.statistics(docs), f"{index}/statistics")
    staging = f"{index}/references.new-{uuid.uuid4().hex}"
    C.reference_index(docs.select(T.doc_key(F.col("repo"), F.col("id")).alias("key"), "references"), 1).write(staging)
    R.replace_dir(spark, staging, f"{index}/references")


def consolidate_authors(spark: SparkSession, index: str, overrides: str | None = None) -> None:
    """Names of all documents to groups, ids that stay over rebuilds, profiles, and the indices of names and profiles."""
    docs = spark.read.parquet(f"{index}/documents")
    listed = docs.select("repo", F.col("id").alias("doc"), "creators", "contributors", "keywords", "description", F.transform("references", lambda r: r["text"]).alias("references"))
    raw = save(A.raw_profiles(listed), "raw-authors")
    text = "\n".join(r.value for r in spark.read.text(overrides).collect()) if overrides else None
    extra = P.load_overrides(text)
    clusters = save(P.precision_clusters(raw.select("name")), "clusters")
    groups = save(P.apply_overrides(clusters, *(P.override_edges(spark, extra[k]) for k in ("merge", "split", "impute"))), "groups")
    try:
        before = save(spark.read.parquet(f"{index}/author-ids"), "author-ids")
    except AnalysisException:  # the first time
        before = None
    ids = save(P.consolidated_ids(groups, raw.select("name", "doc_count"), before), "author-ids")
    authors = save(A.roll_up(raw, ids), "authors")
    R.replace_table(ids, f"{index}/author-ids")
    R.replace_table(authors, f"{index}/authors")
    for name, made in (("author-names", A.name_index(authors)), ("author-profiles", A.profile_index(authors, 1))):
        staging = f"{index}/{name}.new-{uuid.uuid4().hex}"
        made.write(staging)
        R.replace_dir(spark, staging, f"{index}/{name}")


def _documents(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.parquet(f"{index}/documents").withColumn("key", T.doc_key(F.col("repo"), F.col("id")))


def find(spark: SparkSession, command: str, index: str, **a) -> DataFrame:
    """Rows of a question to the stored tables: also what the HTTP surface answers with."""
    top, offset, repo = a.get("top") or 10, a.get("offset") or 0, a.get("repo")
    if command in ("authors", "similar-authors"):
        authors, names = spark.read.parquet(f"{index}/authors"), S.Index.read(spark, f"{index}/author-names")
        if command == "authors":
            return A.search_authors(authors, names, {"q": a["q"]}, top, offset, repo).drop("qid")
        of = A.resolve(authors, names, {"q": a["author"]}).select("consolidated_id")
        return A.similar_authors(authors, S.Index.read(spark, f"{index}/author-profiles"), of, top, repo=repo).drop("qid")
    if command == "stats":
        return G.of_scope(spark.read.parquet(f"{index}/statistics"), repo)
    docs = _documents(spark, index)
    if command == "document":
        return C.document(docs, a["key"])
    if command == "document-references":
        return C.document_references(docs, a["key"])
    refs = S.Index.read(spark, f"{index}/references")
    if command == "references":
        return C.search_references(docs, refs, {"q": a["q"]}, top, offset, repo).drop("qid")
    return C.similar_by_references(docs, refs, spark.createDataFrame([(a["key"],)], "key string"), top).drop("qid")


def _described(hits: DataFrame, docs: DataFrame) -> DataFrame:
    about = docs.select("key", "title", "creators", "year", "type", T.snippet(F.col("description"), F.col("title")).alias("snippet"))
    return hits.join(about, "key", "left").orderBy("rank")


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The rows to print, if the command has any."""
    if a.command in ("build-corpus", "prepare-index"):
        build_corpus(spark, a.data, a.index)
    if a.command in ("index", "prepare-index"):
        build_index(spark, a.index)
    if a.command == "status":
        return R.records(spark, a.data).where("id is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("records"), F.count("file").alias("files")).orderBy("repo")
    if a.command == "info":
        return spark.read.parquet(f"{a.index}/statistics").orderBy("scope")
    if a.command == "clean":
        return spark.createDataFrame([(x,) for x in forget_older(spark, a.days)], "deleted string")
    if a.command == "harvest":
        ends = json.loads("".join(r.value for r in spark.read.text(a.repos).collect()))
        return R.harvest_into(spark, ends, a.data, datetime.date.today().isoformat(), not a.full)
    if a.command == "consolidate-authors":
        consolidate_authors(spark, a.index, a.overrides)
    if a.command in FOUND:
        return find(spark, a.command, a.index, **{k: v for k, v in vars(a).items() if k not in ("command", "index", "data")})
    if a.command in ("search", "similar"):
        docs = spark.read.parquet(f"{a.index}/documents").withColumn("key", T.doc_key(F.col("repo"), F.col("id")))
        index = S.Index.read(spark, f"{a.index}/search")
        if a.command == "similar":
            return _described(S.similar_documents(index, spark.createDataFrame([(a.key,)], "key string"), a.top), docs)
        limits = {k: getattr(a, k) for k in ("repo", "keyword", "doc_type", "year_min", "year_max")}
        allowed = S.document_filter(docs, **limits) if any(v is not None for v in limits.values()) else None
        terms = S.correct_query(S.query_terms(spark, {"q": a.q}, T.text_tokens), index.terms)
        return _described(S.top(S.scores(index, terms, allowed), a.top, a.offset), docs)
    return None


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("folioforge").getOrCreate()
    try:
        rows = run(spark, a)
        for line in rows.toJSON().collect() if rows is not None else ():
            print(line)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
