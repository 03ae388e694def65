import itertools
import math
import random
import re
import xml.etree.ElementTree as ET

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.functions import names as N
from folioforge.functions import text as T
from folioforge.operators import graph as G
from folioforge.operators import people as P
from folioforge.operators import search as S
from folioforge.operators.components import connected_components
from folioforge.plans import queries
from folioforge.sources import records as R

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if x is None or x is pd.NA or x != x else int(x) if hasattr(x, "is_integer") and float(x).is_integer() else x
    return sorted(str([plain(x) for x in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


# ------------------------------------------------------------------ search
def test_search_invariants(spark):
    docs = spark.createDataFrame([(f"r{k % 3}:{k}", f"r{k % 3}", f"river {'stone ' * (k % 5)} word{k}") for k in range(30)] + [("r0:x", "r0", None)], "key string, repo string, text string")
    index = S.build_index(docs, "key", T.tokens(F.col("text")))
    q = S.query_terms(spark, {"a": "Stone river"})
    full = S.top(S.scores(index, q), 100).orderBy("rank").collect()
    assert [r.score for r in full] == sorted((r.score for r in full), reverse=True) and len(full) == 30
    only = S.top(S.scores(index, q, S.document_filter(docs, repo="r1")), 100).orderBy("rank").collect()
    assert [(r.key, r.score) for r in only] == [(r.key, r.score) for r in full if r.key.startswith("r1")]
    assert S.scores(index, q, S.document_filter(docs, repo="none")).count() == 0
    pages = [S.top(S.scores(index, q), 12, o).collect() for o in (0, 12, 24)]
    assert [p[0].has_more for p in pages] == [True, True, False]
    assert len({r.key for p in pages for r in p}) == 30


def test_searches_count_only_their_terms_and_sum_them_in_place(spark):
    rows_ = [(k % 25, f"river {'stone ' * (k % 5)} word{k}") for k in range(30)] + [(None, "stone"), (40, None)]
    for docs in (rows_, rows_[:25]):  # with keys that repeat, and without
        index = S.build_index(spark.createDataFrame(docs, "key int, text string"), "key", T.tokens(F.col("text")))
        words = {}
        for key, text in docs:
            words.setdefault(key, []).extend((text or "").split())
        df = {t: sum(t in w for w in words.values()) for t in {t for w in words.values() for t in w}}
        assert {r.term: r.df for r in index.terms.collect()} == df
        q = S.query_terms(spark, {"a": "Stone word3"})
        few = index.of(q)
        assert {r.term: r.df for r in few.terms.collect()} == {t: df[t] for t in ("stone", "word3")}
        assert {(r.key, r.term, r.tf) for r in few.postings.collect()} == {(k, t, w.count(t)) for k, w in words.items() for t in ("stone", "word3") if t in w}
        plan = few.postings._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") < plan.index("LeftSemi")
        for scored in (S.scores(index, q), S.scores(index, q, partitions=7)):
            assert not re.search(r"hashpartitioning\(qid#\d+, key", scored._jdf.queryExecution().executedPlan().toString())
            n, mean = sum(bool(w) for w in words.values()), sum(map(len, words.values())) / sum(bool(w) for w in words.values())
            want = {k: round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ("stone", "word3") if t in w), 6) for k, w in words.items() if k is not None and {"stone", "word3"} & set(w)}
            assert {r.key: r.score for r in scored.collect()} == want


def test_variants_and_storage(spark, tmp_path):
    docs = spark.createDataFrame([(k, "remoción de tierra") for k in range(20)] + [(99, "remocion")], "key int, text string")
    index = S.build_index(docs, "key", T.tokens(F.col("text")))
    index.write(str(tmp_path / "index"))
    again = S.Index.read(spark, str(tmp_path / "index"))
    q = S.correct_query(S.query_terms(spark, {"a": "REMOCION"}), again.terms)
    assert [r.term for r in q.collect()] == ["remoción"]
    assert {(r.term, r.form) for r in S.variant_forms(again.terms).collect()} == {("remocion", "remoción")}


def test_paragraphs(spark):
    text = "a" * 100 + "\n\n" + "b" * 60 + "\n\n12\n\nshort"
    assert one(spark, text, T.paragraphs) == ["a" * 100 + " " + "b" * 60 + " short"]
    assert one(spark, text, lambda c: T.paragraphs(c, 80, 120)) == ["a" * 100]
    assert one(spark, None, T.paragraphs) == []
    hits = S.paragraph_search(spark.createDataFrame([(1, "Resumen " + "river " * 20 + "\n\n" + "Conclusiones " + "stone " * 300)], "k int, t string"), "k", "t", "stone").collect()
    assert [h.section for h in hits] == ["Conclusiones"] or len(hits) == 1


def test_ngrams(spark):
    assert one(spark, "a b c d", lambda c: T.text_tokens(c, ngrams=(1, 2, 3))) == ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"]


def test_paragraph_search_equals_brute_force(spark):
    draw = random.Random(5)
    docs = [(k, "\n\n".join(" ".join(draw.choice("the thing of here there stone river".split()) for _ in range(draw.choice([150, 200, 290]))) for _ in range(draw.randrange(1, 7)))) for k in range(30)] + [(31, None), (32, "-" * 100), (None, "the " * 50)]
    terms = ["the", "thing", "of", "here", "the thing", "thing of", "of here"]
    want = set()
    for key, text in docs[:30]:
        words = [x.split() for x in one(spark, text, T.paragraphs)]
        words = [w + [" ".join(p) for p in itertools.pairwise(w)] for w in words]
        n, mean = len(words), sum(map(len, words)) / len(words)
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t in terms for d in [sum(t in w for w in words)]}
        scored = [(-round(sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms), 6), i) for i, w in enumerate(words, 1)]
        want |= {(key, i, rank, -s) for rank, (s, i) in enumerate(sorted(scored)[:3], 1)}
    got = S.paragraph_search(spark.createDataFrame(docs, "k int, t string"), "k", "t", "the thing of here", 3).collect()
    assert len(want) > 60 and {(r.key, r.paragraph_num, r["rank"], r.score) for r in got} == want


# ------------------------------------------------------------------ text
@pytest.mark.parametrize(("raw", "want"), [("Perez, Juan", "Juan Perez"), ("Juan Perez", "Juan Perez"), (", Juan", ", Juan"), ("A, B, C", "B, C A")])
def test_name_swap(spark, raw, want):
    assert one(spark, raw, T.name_swap) == want


def test_small_text_functions(spark):
    assert one(spark, "Pérez-Gil, Ana", T.name_key) == "ana_pérez_gil"
    assert one(spark, "in 1850 and 1999-2003", T.year_of) == 1999 and one(spark, "none", T.year_of) is None
    assert one(spark, "Master Thesis", T.doc_type) == "Tesis"
    assert one(spark, "Juan Carlos Pérez", T.initials_form) == "J C Pérez" and one(spark, "Ana", T.initials_form) == "Ana"
    assert one(spark, "ab", T.qgrams) == ["^ab$"] and one(spark, "abcd", T.qgrams) == ["^abc", "abcd", "bcd$"]
    assert one(spark, "see http://a.b/c A22-x", lambda c: T.text_tokens(c, ngrams=(1, 2)))[:4] == ["see", "url", "a0", "x"]
    assert one(spark, "water; info:eu-repo/classification/cti/33 | info:eu-repo/classification/LCC/QA\nx;water", T.keywords) == ["water", "cti/33", "QA"]


# ------------------------------------------------------------------ people
def test_osa():
    assert [N.osa(*x) for x in (("rcuz", "cruz"), ("ca", "abc"), ("", "ab"), ("same", "same"), ("kitten", "sitting"))] == [1, 3, 2, 0, 3]


def test_name_parts():
    part = lambda x: N.given_surname(N.name_tokens(x))
    assert part("Pérez López, Juan Carlos") == (("juan", "carlos"), ("perez", "lopez"))
    assert part("María de la Cruz Soto") == (("maria",), ("de-la-cruz", "soto"))
    assert part("Ruiz") == ((), ("ruiz",)) and part("Ana Ruiz") == (("ana",), ("ruiz",))
    assert N.block_keys("Ana de la Cruz Soto") == ["cruz", "soto"] and N.is_garbage("0000-0001-1111")


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.grp, set()).add(r.name)
    return {frozenset(x) for x in out.values()}


CROWD = ["Juan Carlos Pérez López", "Pérez López, Juan Carlos", "Juan Carlos Perez Lopes", "Laura Pérez López", "Ana Ruiz Soto", "Ana Ruis Soto", "A. Ruiz Soto", "Rosa Ruiz Soto", "Luis Gil", "0000-0001-2222"]


def test_clusters_and_partitions(spark):
    df = spark.createDataFrame([(x,) for x in CROWD], "name string")
    got = clusters(P.precision_clusters(df, correct=False))
    assert frozenset(CROWD[:2]) <= next(g for g in got if CROWD[0] in g)
    assert not any({"Ana Ruiz Soto", "Rosa Ruiz Soto"} <= g or {"Ana Ruiz Soto", "A. Ruiz Soto"} <= g for g in got)
    assert frozenset(["0000-0001-2222"]) in got
    assert clusters(P.precision_clusters(df.repartition(13), correct=False)) == got


def test_imputation(spark):
    names = ["Ana María Ruiz Soto", "A. María Ruiz Soto", "Luis Gil Mora", "L. Gil Mora", "Lucas Gil Mora"]
    groups = spark.createDataFrame([(x, x) for x in names], "name string, grp string")
    got = {(r.a, r.b) for r in P.impute_initials(groups).collect()}
    assert got == {("A. María Ruiz Soto", "Ana María Ruiz Soto")}
    co = spark.createDataFrame([("L. Gil Mora", "z"), ("Luis Gil Mora", "z")], "grp string, co string")
    assert ("L. Gil Mora", "Luis Gil Mora") in {(r.a, r.b) for r in P.impute_initials(groups, co).collect()}


def test_imputation_weak_and_cliques(spark):
    """Weak: only the middle initial agrees.  Clique: a chain through initials whose ends are two people."""
    names = ["Tomás A. Lago Mora", "Abel Lago Mora", "Eva Rey Paz", "E. Rey Paz", "E. Rey", "Elsa Rey"]
    groups = spark.createDataFrame([(x, x) for x in names], "name string, grp string")
    assert P.impute_initials(groups.where("name like '%Lago%'")).collect() == []
    every = spark.createDataFrame([(x, "z") for x in names], "grp string, co string")
    got = {(r.a, r.b) for r in P.impute_initials(groups, every).collect()}
    assert ("Abel Lago Mora", "Tomás A. Lago Mora") in got
    # Eva and Elsa never end in one component, whatever edges are left.
    root = {x: x for x in names}
    for _ in names:
        for a, b in got:
            root[a] = root[b] = min(root[a], root[b])
    assert root["Eva Rey Paz"] != root["Elsa Rey"]


def test_first_surname_and_weak():
    name = lambda given, surname, hyphen=False: (tuple(given.split()), tuple(surname.split()), hyphen)
    assert not N.first_surname_agrees(name("luis", "paz"), name("eva r", "lagorri paz", True))
    assert N.first_surname_agrees(name("e", "mora"), name("elsa", "rey mora"))
    assert N.weak(name("tomas a", "lago"), name("abel", "lago")) and not N.weak(name("tomas a", "lago"), name("tomas", "lago"))


def test_corrections(spark):
    vocab = spark.createDataFrame([("hernandez", "surname", 9), ("hernadnez", "surname", 1), ("gil", "surname", 1), ("gila", "given", 9), ("ruiz", "surname", 5), ("ruis", "surname", 2)], "token string, role string, n long")
    assert {(r.token, r.corrected) for r in P.corrections(vocab).collect()} == {("hernadnez", "hernandez")}


def test_neighbours_are_exact(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(120)})
    df = spark.createDataFrame([("r", w) for w in words], "role string, token string")
    assert {(r.token, r.other) for r in P.neighbours(df).collect()} == {(a, b) for a in words for b in words if a != b and N.osa(a, b) <= 1}


def test_overrides_and_ids(spark):
    c = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "name string, grp string")
    pair = lambda *x: spark.createDataFrame(list(x), "a string, b string")
    got = {r.name: r.grp for r in P.apply_overrides(c, pair(("c", "d"), ("c", "nobody")), pair(("b", "a"))).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "d": "c"}
    ids = P.raw_ids(spark.createDataFrame([(x,) for x in CROWD], "name string")).collect()
    assert len({r.raw_id for r in ids}) == len(CROWD) and {r.raw_id.split("_")[0] for r in ids} >= {"lopez", "soto", "gil"}
    members = spark.createDataFrame([("g", "x", 5), ("g", "y", 9), ("h", "z", 1)], "grp string, name string, doc_count long")
    assert {r.grp: r.leader for r in P.choose_leaders(members).collect()} == {"g": "y", "h": "z"}
    before = spark.createDataFrame([("x", 3)], "name string, size long")
    assert {r.grp: r.leader for r in P.choose_leaders(members, before).collect()} == {"g": "x", "h": "z"}


def test_lost_letters(spark):
    w = spark.createDataFrame([(x,) for x in ["garcia", "garcia", "garbia", "gar?ia", "g?r?ia", "zz?", "??rcia", "??????", "?"]], "word string")
    assert {r.word: r.repaired for r in P.lost_letters(w).collect()} == {"gar?ia": "garcia", "g?r?ia": "garcia", "zz?": None, "??rcia": "garcia", "??????": "garcia", "?": None}


def test_pairs_of_a_bucket_are_all_found(spark):
    """Blocking by given words loses no pair that the predicate would take."""
    rng = random.Random(6)
    given = ["ana", "maria", "maximiliano", "maximilano", "guadalupe", "guadaluoe", "j", "ana-luisa", "constantinopolitana", "constantinopolitano"]
    names = sorted({" ".join([*rng.sample(given, rng.randrange(0, 3)), *rng.choice([("ruiz",), ("ruiz", "paz"), ("ruis", "paz"), ("paz",)])]).title() for _ in range(90)})
    sig = P.signatures(P.name_parts(spark.createDataFrame([(x,) for x in names], "name string")))
    reps = {r.rep: (tuple(r.given), tuple(r.surname), set(r["keys"])) for r in sig.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(reps), 2) if reps[a][2] & reps[b][2] and N.same_person(reps[a][:2], reps[b][:2])}
    assert want and {(r.a, r.b) for r in P.compared(sig, "same_person").collect()} == want


def test_clusters_against_brute_force(spark):
    """Components of the pairwise predicate, split greedily where a pair contradicts."""
    rng = random.Random(7)
    names = sorted({f"{rng.choice(['Ana', 'Ana María', 'Rosa', 'Luis Alberto', 'Luis'])} {rng.choice(['Ruiz', 'Paz', 'Ruiz Paz', 'Paz Lago', 'Lago Ruiz'])}" for _ in range(60)})
    parts = {x: N.given_surname(N.name_tokens(x)) for x in names}
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(names, 2):
        if set(N.block_keys(a)) & set(N.block_keys(b)) and N.same_person(parts[a], parts[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    groups: dict = {}
    for x in names:
        groups.setdefault(find(x), []).append(x)
    want = set()
    for g in groups.values():
        if not any(N.contradicts(parts[a], parts[b]) for a, b in itertools.combinations(g, 2)):
            want.add(frozenset(g))
            continue
        split: list = []
        for x in sorted(g, key=str.encode):
            for p in split:
                if all(N.same_person(parts[x], parts[o]) and not N.contradicts(parts[x], parts[o]) for o in p):
                    p.append(x)
                    break
            else:
                split.append([x])
        want |= {frozenset(p) for p in split}
    assert clusters(P.precision_clusters(spark.createDataFrame([(x,) for x in names], "name string"), correct=False)) == want


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)] + [("hub", f"h{k}") for k in range(300)] + [(f"c{k}", f"c{k + 1}") for k in range(40)] + [(None, "x"), ("y", "y")]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}


def test_qgram_pairs_against_brute_force(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    grams = lambda w: {f"^{w}$"[i : i + 4] for i in range(max(1, len(w) - 1))}
    sim = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    for least in (0.3, 0.6):
        got = {(r.a, r.b) for r in P.qgram_pairs(spark.createDataFrame([(w,) for w in words], "w string"), least).collect()}
        assert got == {(a, b) for a, b in itertools.combinations(words, 2) if sim(a, b) >= least}


def test_overrides_of_a_file_and_ids_over_rebuilds(spark):
    got = P.load_overrides('merge = [["a", "b", "c"], ["alone"]]\nsplit = [["a", "b"], ["a", "b", "c"]]\n')
    assert got == {"merge": [["a", "b", "c"]], "split": [["a", "b"]], "impute": []} and P.load_overrides(None)["merge"] == []
    assert sorted((r.a, r.b) for r in P.override_edges(spark, got["merge"]).collect()) == [("a", "b"), ("a", "c")]
    groups = lambda d: spark.createDataFrame([(n, g) for g, names in d.items() for n in names], "name string, grp string")
    counts = spark.createDataFrame([("Ana Paz", 5), ("A. Paz", 2), ("Eva Rey", 9), ("E. Rey", 1)], "name string, doc_count long")
    first = P.consolidated_ids(groups({"g": ["Ana Paz", "A. Paz"], "h": ["Eva Rey", "E. Rey"]}), counts).cache()
    ids = {r.name: r.consolidated_id for r in first.collect()}
    assert ids["Ana Paz"] == ids["A. Paz"] != ids["Eva Rey"] == ids["E. Rey"] and {r.name for r in first.collect() if r.leader} == {"Ana Paz", "Eva Rey"}
    again = {r.name: r.consolidated_id for r in P.consolidated_ids(groups({"x": ["Ana Paz", "A. Paz", "Luz Sol"], "y": ["Eva Rey"], "z": ["E. Rey"]}), counts, first).collect()}
    assert again["Luz Sol"] == again["Ana Paz"] == ids["Ana Paz"] and again["Eva Rey"] == ids["Eva Rey"] != again["E. Rey"]
    # A group that moved to another leader: its former raw id isn't given to a new one.
    before = spark.createDataFrame([("Old", ids["Ana Paz"], True)], "name string, consolidated_id string, leader boolean")
    moved = {r.name: r.consolidated_id for r in P.consolidated_ids(groups({"g": ["Old"], "n": ["Ana Paz"]}), counts, before).collect()}
    assert moved == {"Old": ids["Ana Paz"], "Ana Paz": ids["Ana Paz"] + "_00"}


# ------------------------------------------------------------------ graph, sources, streaming
def test_statistics_and_network(spark):
    d = spark.createDataFrame([(1, "r1", "f", True, 2, "thesis", ["water", "tesis"], 2001), (2, "r2", None, False, 0, "book", ["water"], 1800)], "doc int, repo string, file string, has_fulltext boolean, reference_count int, type string, keywords array<string>, year int")
    s = {r.scope: r for r in G.statistics(d).collect()}
    assert s["global"].documents == 2 and s["global"].files == 1 and s["global"].year_min == 2001 and s["repo:r2"].year_min is None
    assert [(t.value, t.n) for t in s["global"].topics] == [("water", 2), ("tesis", 1)]
    refs = spark.createDataFrame([("r1:1#1", "1", ["Gil, Ana", "X"])], "ref_id string, doc string, authors array<string>")
    assert [(r.cited_key, r.ref_id) for r in G.citation_edges(refs).collect()] == [("ana_gil", "r1:1#1")]
    authors = spark.createDataFrame([("1", "Ana Gil"), ("1", "Bo Li"), ("2", "Ana Gil"), ("2", "Cy Ma")], "doc string, author string")
    nodes, edges = G.author_network("Ana Gil", G.coauthor_edges(authors), G.citation_edges(refs), authors)
    assert {(e.target, e.kind) for e in edges.collect()} == {("Bo Li", "coauthor"), ("Cy Ma", "coauthor"), ("Ana Gil", "cites")}
    assert nodes.count() == 3


def test_records(spark, tmp_path):
    (tmp_path / "repo=r1").mkdir()
    (tmp_path / "repo=r1/metadata.jsonl").write_text('{"id": "1", "xml": "<dc:r><dc:title> A </dc:title><dc:creator>Gil, Ana</dc:creator><dc:creator>Li, Bo</dc:creator><dc:type>thesis</dc:type><dc:date>2001-05</dc:date></dc:r>", "file": "x/one.pdf"}\n\nnot json\n{"id": "2", "xml": "<broken"}\n')
    raw = R.records(spark, str(tmp_path)).where("id is not null")
    texts = spark.createDataFrame([("one", "x\nReferencias\n[1] Ruiz, Eva (1999). A title that is long enough.\n")], "name string, text string")
    d = {r.id: r for r in R.build_corpus(raw, texts).collect()}
    assert d["1"].creators == ["Gil, Ana", "Ana Gil", "Li, Bo", "Bo Li"] and d["1"].year == 2001 and d["1"].type == "Tesis"
    assert d["1"].reference_count == 1 and d["1"].references[0].year == "1999" and d["1"].references[0].ref_id == "r1:1#1" and d["2"].title == ""
    assert R.read_jsonl(spark, str(tmp_path / "none"), R.RECORD).count() == 0
    R.replace_table(spark.range(3).toDF("a"), str(tmp_path / "t"))
    R.replace_table(spark.range(5).toDF("a"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_harvest():
    page = lambda ids, token: "<O><ListRecords>" + "".join(f"<record><header><identifier>{i}</identifier></header></record>" for i in ids) + f"<resumptionToken>{token}</resumptionToken></ListRecords></O>"
    site = {"http://x/oai?verb=ListRecords&from=2020-01-02": page("ab", "t 1"), "http://x/oai?verb=ListRecords&resumptionToken=t%201": page("c", "")}
    assert [i for i, _ in R.harvest_pages("http://x/oai?verb=ListRecords", "2020-01-02T00:00", site.__getitem__)] == ["a", "b", "c"]
    assert list(R.harvest_pages("u", None, lambda u: "<O><error/></O>")) == [] == list(R.harvest_pages("u", None, lambda u: ""))
    got = R.harvest_pages("http://x/oai?verb=ListRecords", None, lambda u: page("a", "t") if "Token" not in u else "<broken")
    assert next(got)[0] == "a"
    with pytest.raises(ET.ParseError):
        next(got)


def test_harvest_of_all_keeps_errors_and_cursors(spark):
    def site(url):
        if "bad" in url and "Token" in url:
            raise OSError("gone")
        return "<O><ListRecords><record><header><identifier>" + url[7:10] + "</identifier></header></record><resumptionToken>" + ("" if "Token" in url else "t") + "</resumptionToken></ListRecords></O>"

    ends = spark.createDataFrame([("r1", "http://one/oai", "2020-01-01"), ("r2", "http://bad/oai", None)], "repo string, endpoint string, since string")
    got = R.harvest_all(ends, site).cache()
    assert sorted((r.repo, r.id, r.error) for r in got.collect() if r.id) == [("r1", "one", None), ("r1", "one", None), ("r2", "bad", None)]
    assert [(r.repo, "gone" in r.error) for r in got.collect() if r.error] == [("r2", True)]
    assert {r.repo: r.since for r in R.next_cursor(ends, got, "2021").collect()} == {"r1": "2021", "r2": None}


def test_catalog_and_links(spark):
    d = spark.createDataFrame([(1, ["water", "cti/33", "cti/999"])], "doc int, keywords array<string>")
    c = spark.createDataFrame([("33", "Técnica"), ("999", "Wrong length")], "code string, name string")
    assert R.resolve_keywords(d, c, ("doc",)).first().keywords == ["water", "Técnica"]
    p = spark.createDataFrame([(1, "http://h/a/b?x", '<a href="/privacy.pdf"><a href="../q.htmlx"><a href="t.pdf?d=1">'), (2, "http://h/a/", "<p>")], "k int, url string, html string")
    assert [(r.key, r.link) for r in R.document_links(p, "k", "url", "html").collect()] == [(1, "http://h/a/t.pdf")]


def test_stream(spark, tmp_path):
    from folioforge.streaming import harvest as H

    landing = tmp_path / "in"
    landing.mkdir()
    run = lambda: H.start(H.first_writes(H.record_stream(spark, str(landing))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (landing / "1.json").write_text('{"id": "a", "repo": "r", "xml": "1"}\n{"id": "b", "repo": "r", "xml": "1"}\n')
    run()
    (landing / "2.json").write_text('{"id": "a", "repo": "r", "xml": "2"}\n{"id": "c", "repo": "r", "xml": "2"}\n')
    run()
    assert {(r.id, r.xml) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "1"), ("b", "1"), ("c", "2")}


def test_parts_of_graph_joins_grow_with_the_input(spark, tmp_path, monkeypatch):
    x = spark.createDataFrame([(d, a) for d in range(40) for a in (d % 3, d % 5, d % 7, d % 5)], "doc int, author int")
    want = {tuple(r) for r in G.coauthor_edges(x).collect()}
    monkeypatch.setattr(G, "parts_of", lambda df: 37)
    edges = G.coauthor_edges(x)
    assert {tuple(r) for r in edges.collect()} == want and len(want) > 5
    assert {(r.a, r.b, r.weight) for r in G.both_ways(edges).collect()} == want | {(b, a, n) for a, b, n in want}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert all(re.search(rf"RepartitionByExpression \[{k}#\d+.*\], 37", plan) for k in ("doc", "a"))


@pytest.mark.parametrize("kind", ["string", "long"])
def test_components_sort_no_hub_and_deal_rows_by_their_number(spark, monkeypatch, kind):
    from folioforge.operators import components as C

    hubs = [(0, k) for k in range(100, 400)] + [(1000, 1000 + k) for k in range(1, 200)] + [(1500 + 2 * k, 1501 + 2 * k) for k in range(40)] + [(2000 + k, 2001 + k) for k in range(30)]
    df = spark.createDataFrame(hubs + [(7, 7), (None, 3)], "a long, b long").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b")
    plans, kept = [], C.save

    def save(x, name):
        plans.append(x._jdf.queryExecution().executedPlan().toString())
        return kept(x, name)

    monkeypatch.setattr(C, "save", save)
    monkeypatch.setattr(C, "PART_ROWS", 60, raising=False)
    monkeypatch.setattr(C, "SMALL_ROWS", 8, raising=False)
    if kind == "string":  # hashes that collide are given up
        number = C._number
        monkeypatch.setattr(C, "_number", lambda c, seed: F.length(c).cast("long") if seed == 0 else number(c, seed))
    out = C.connected_components(df)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    low = lambda v: 0 if v < 1000 else 1000 if v < 1200 else v - v % 2 if v < 2000 else 2000
    if kind == "string":
        names = {v: str(v) for e in hubs for v in e}
        least: dict = {}
        for v, s in names.items():
            least[low(v)] = min(s, least.get(low(v), s))
        want = {names[v]: least[low(v)] for v in names}
    else:
        want = {v: low(v) for e in hubs for v in e}
    assert {r.node: r.component for r in out.collect()} == want and dict(out.dtypes) == {"node": df.dtypes[0][1], "component": df.dtypes[0][1]}
    assert not any("SortMergeJoin" in p for p in plans) and any(re.search(r"hashpartitioning\(v#\d+L, 1\d\), REPARTITION_BY_NUM", p) for p in plans)


def test_topics_are_dealt_by_document_once_and_authors_of_a_repository_first(spark, monkeypatch):
    monkeypatch.setattr(G, "parts_of", lambda df: 37)
    monkeypatch.setattr(queries, "parts_of", lambda df: 37, raising=False)
    for name in ("topic_authors", "topic_repo_authors_semi"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(doc#\d+L, 37\), REPARTITION_BY_NUM", plan) and len(re.findall(r"Exchange hashpartitioning\(doc#", plan)) == 3
    # The authors of the repository are chosen below the join by document.
    x = spark.createDataFrame([("t", 1), ("u", 2), ("t", 2)], "tag string, doc long")
    who = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7)], "doc long, author long")
    own = spark.createDataFrame([(5,), (7,), (7,), (9,)], "author long")
    out = G.topic_authors(x, who, own)
    assert sorted(map(tuple, out.collect())) == [("t", 5), ("t", 7), ("u", 7)]
    assert sorted(map(tuple, G.topic_authors(x, who).collect())) == [("t", 5), ("t", 6), ("t", 7), ("u", 6), ("u", 7)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
