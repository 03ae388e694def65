"""Author and reference search on a small corpus: twenty documents of three repositories, six people, five topics."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import authors as A
from folioforge.operators import graph as G
from folioforge.operators import references as C
from folioforge.operators import search as S

PEOPLE = ["Lago Mora, Eva", "Paz Rey, Tomás", "Inés Sol", "Abel Río", "Ruth Mar Luz", "Leo Campo"]
TOPICS = ["river salmon", "bridge steel", "maize yield", "coral reef", "glacier melt"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for n in range(20):
        repo = "r1" if n < 10 else "r2" if n < 18 else "r3"
        refs = [(f"{repo}:{n}#{k + 1}", f"Common survey of {TOPICS[(n + k) % 5]} by cited author {k}") for k in range(n % 4)]
        rows.append((repo, str(n), f"{repo}:{n}", f"On {TOPICS[n % 5]} {n}", PEOPLE[n % 6], [PEOPLE[n % 6], PEOPLE[(n + 1) % 6]], [PEOPLE[(n + 2) % 6]], [TOPICS[n % 5], f"tema {n % 3}"], f"About {TOPICS[n % 5]}", refs))
    return spark.createDataFrame(rows, "repo string, doc string, key string, title string, creator string, creators array<string>, contributors array<string>, keywords array<string>, description string, references array<struct<ref_id: string, text: string>>").cache()


@pytest.fixture(scope="module")
def authors(corpus):
    raw = A.raw_profiles(corpus.withColumn("references", F.transform("references", lambda r: r["text"])))
    groups = raw.select("name", F.when(F.col("name") == "Inés Sol", "c2").when(F.col("name") == "Abel Río", "c2").otherwise(F.concat(F.lit("id_"), F.regexp_replace("name", r"\W+", "_"))).alias("consolidated_id"))
    return A.roll_up(raw, groups).cache()


def test_profiles(corpus, authors):
    raw = {r.name: r for r in A.raw_profiles(corpus.withColumn("references", F.transform("references", lambda r: r["text"]))).collect()}
    assert set(raw) == set(PEOPLE) and sum(r.doc_count for r in raw.values()) == 60
    eva = raw[PEOPLE[0]]
    docs = [n for n in range(20) if PEOPLE[0] in (PEOPLE[n % 6], PEOPLE[(n + 1) % 6], PEOPLE[(n + 2) % 6])]
    assert eva.doc_count == len(docs) == len(eva.doc_ids) and eva.role == "Autor" and eva.repos == ["r1", "r2", "r3"]
    assert eva.keywords[:2] == [TOPICS[0], "tema 0"] and PEOPLE[0] not in eva.coauthors and len(eva.cited_references) <= 30
    both = {r.consolidated_id: r for r in authors.collect()}["c2"]
    assert both.raw_names == ["Abel Río", "Inés Sol"] and both.doc_count == raw["Abel Río"].doc_count + raw["Inés Sol"].doc_count


def test_search_authors(authors):
    index = A.name_index(authors)
    got = A.search_authors(authors, index, {"a": "eva lago", "b": "E MORA", "c": "nobody", "d": "tomas"}).collect()
    by = {}
    for r in got:
        by.setdefault(r.qid, []).append(r)
    assert set(by) == {"a", "b", "d"} and all(v[0].name == PEOPLE[0] for k, v in by.items() if k != "d") and by["d"][0].name == PEOPLE[1]
    assert by["a"][0].score > 0 and by["a"][0].rank == 1 and not by["a"][0].has_more
    assert A.search_authors(authors, index, {"a": "eva"}, repo="none").collect() == []
    some = A.search_authors(authors, index, {"a": "eva"}, repo="r3").collect()
    assert [(r.name, r.score) for r in some] == [(r.name, r.score) for r in A.search_authors(authors, index, {"a": "eva"}).collect() if "r3" in r.repos]


def test_resolve_and_similar(authors):
    index = A.name_index(authors)
    got = {r.qid: r.consolidated_id for r in A.resolve(authors, index, {"id": "c2", "raw": "abel río", "best": "eva", "none": "zzz"}).collect()}
    assert got == {"id": "c2", "raw": "c2", "best": "id_Lago_Mora_Eva"}
    hits = A.similar_authors(authors, A.profile_index(authors), authors.where("consolidated_id = 'c2'").select("consolidated_id"), 3).collect()
    assert 0 < len(hits) <= 3 and "c2" not in {r.consolidated_id for r in hits} and [r.rank for r in hits] == list(range(1, len(hits) + 1))


def test_references(spark, corpus):
    index = C.reference_index(corpus, min_df=2)
    hits = C.search_references(corpus, index, {"q": "salmon"}, 50).collect()
    want = {f"{'r1' if n < 10 else 'r2' if n < 18 else 'r3'}:{n}" for n in range(20) if any((n + k) % 5 == 0 for k in range(n % 4))}
    assert {r.key for r in hits} == want and all(r.total_references == int(r.key.split(":")[1]) % 4 and len(r.sample_references) <= 3 for r in hits)
    assert {r.key for r in C.search_references(corpus, index, {"q": "salmon"}, 50, 0, "r2").collect()} == {k for k in want if k.startswith("r2")}
    near = C.similar_by_references(corpus, index, spark.createDataFrame([("r1:3",), ("r1:4",)], "key string"), 5).collect()
    assert {r.qid for r in near} == {"r1:3", "r1:4"} and not any(r.qid == r.key for r in near)  # r1:4 has none: by its description
    assert [(r.ref_num, r.text[-1]) for r in C.document_references(corpus, "r1:3").collect()] == [(1, "0"), (2, "1"), (3, "2")]
    stored = spark.createDataFrame([("r1:3", 1, "kept")], "key string, ref_num int, text string")
    assert [r.text for r in C.document_references(corpus, "r1:3", stored).collect()] == ["kept"]
    assert C.document(corpus, "r9:1").collect() == [] and C.document(corpus, "r1:1").first().title == "On bridge steel 1"


def test_researchers_and_scopes(corpus):
    top = [r for r in G.top_researchers(corpus, 3).orderBy("scope", "rank").collect() if r.scope == "global"]
    assert [r.rank for r in top] == [1, 2, 3] and top[0].n >= top[1].n >= top[2].n and top[0].role in A.ROLES
    d = corpus.withColumn("file", F.lit(None).cast("string")).withColumn("has_fulltext", F.lit(False)).withColumn("reference_count", F.size("references")).withColumn("type", F.lit("tesis")).withColumn("year", F.lit(2000))
    s = G.statistics(d)
    assert G.of_scope(s, "r2").first().documents == 8 and G.of_scope(s, " all ").first().documents == 20
    assert G.of_scope(s, "r9").first().error == "no documents for repo:r9" and G.of_scope(s).first().error is None


def test_queries_are_corrected(spark):
    docs = spark.createDataFrame([(k, "remoción de tierra") for k in range(20)] + [(99, "remocion")], "key int, text string")
    index = S.build_index(docs, "key", F.split("text", " "))
    q = S.query_terms(spark, {"a": "REMOCION"})
    assert S.scores(index, S.correct_query(q, index.terms)).count() == 20 and S.scores(index, q).count() == 1
