"""Queries of the engine over the driver's tables, with the SQL of each.

Orders play documents, suppliers authors, part types topics, nations repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import authors as A
from ..operators import graph as G
from ..operators import people as P
from ..operators import references as C
from ..operators import search as S
from ..operators.components import connected_components
from ..sources import records as R
from .shared import parts_of

Q = {"q1": "the thing of here", "q2": "avec la nation", "q3": "der die und zu"}
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark, sf_dir, config=S.Bm25()):
    return S.build_index(table(spark, sf_dir, "documents"), "doc_id", T.tokens(F.col("text")), config)


_BM25 = f"""
WITH q(qid, q) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in Q.items())}),
qt AS (SELECT DISTINCT qid, unnest({TOKENS.format("q")}) AS term FROM q),
p AS (SELECT key, term, count(*) AS tf FROM (SELECT doc_id AS key, unnest({TOKENS.format("text")}) AS term FROM documents) GROUP BY key, term),
l AS (SELECT key, sum(tf) AS len FROM p GROUP BY key), t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
n AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
s AS (SELECT qid, p.key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
      FROM p JOIN qt USING (term) JOIN t USING (term) JOIN l ON l.key = p.key, n GROUP BY qid, p.key)
"""


def _page(where: str, k: int, offset: int = 0) -> str:
    return _BM25 + f""", r AS (SELECT qid, s.key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, s.key) AS rank FROM s JOIN documents d ON d.doc_id = s.key {where}),
m AS (SELECT qid, max(rank) AS last FROM r GROUP BY qid)
SELECT r.qid, r.key, r.score, r.rank, last > {offset + k} AS has_more FROM r JOIN m USING (qid) WHERE rank > {offset} AND rank <= {offset + k}"""


def _search(spark, sf_dir, k, offset=0, allowed=None):
    index = _index(spark, sf_dir)
    return S.top(S.scores(index, S.query_terms(spark, Q), allowed), k, offset).select("qid", "key", "score", "rank", "has_more")


@query(_page("", 10))
def search_topk(spark, sf_dir):
    return _search(spark, sf_dir, 10)


@query(_page("", 10, 10))
def search_page2(spark, sf_dir):
    return _search(spark, sf_dir, 10, 10)


@query(_page("WHERE d.source = 'src3'", 10))
def search_repo_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source = 'src3'")
    return _search(spark, sf_dir, 10, 0, docs.select(F.col("doc_id").alias("key")))


@query(_page("JOIN labels b ON b.doc_id = d.doc_id WHERE d.lang = 'en' AND b.quality = 1", 10))
def search_filtered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    return _search(spark, sf_dir, 10, 0, docs.select(F.col("doc_id").alias("key")))


@query(f"SELECT term, df FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term) WHERE df >= 3")
def term_df_pruned(spark, sf_dir):
    return _index(spark, sf_dir, S.Bm25(min_df=3)).terms


@query(f"""WITH b AS (SELECT DISTINCT item_id::VARCHAR AS qid, unnest({TOKENS.format("text")}) AS term FROM benchmark),
t AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents) GROUP BY term)
SELECT qid, term, df FROM (SELECT qid, term, df, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS r FROM b JOIN t USING (term)) WHERE r <= 16""")
def informative_terms(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.explode(T.tokens(F.col("text"))).alias("term"))
    return S.informative_terms(_index(spark, sf_dir), q)


@query(f"""WITH p AS (SELECT key, term, count(*) AS tf FROM (SELECT doc_id AS key, unnest({TOKENS.format("text")}) AS term FROM documents) GROUP BY key, term),
l AS (SELECT key, sum(tf) AS len FROM p GROUP BY key), t AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
qt AS (SELECT qid, term FROM (SELECT p.key AS qid, term, row_number() OVER (PARTITION BY p.key ORDER BY df, term) AS r FROM p JOIN t USING (term) WHERE p.key % 100 = 0) WHERE r <= 16),
s AS (SELECT qid::VARCHAR AS qid, p.key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM p JOIN qt USING (term) JOIN t USING (term) JOIN l ON l.key = p.key, n WHERE qid <> p.key GROUP BY qid, p.key)
SELECT qid, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= 10""")
def similar_docs_by_terms(spark, sf_dir):
    of = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("key"))
    return S.similar_documents(_index(spark, sf_dir), of).select("qid", "key", "score", "rank")


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN coalesce(lang, '') WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS snippet FROM documents""")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), F.col("lang")).alias("snippet"))


@query()
def paragraph_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return S.paragraph_search(docs, "doc_id", "text", Q["q1"], 3).select("key", "paragraph_num", "score", "rank", "section")


_DOC = "(SELECT o_orderkey AS doc, n_name AS repo, o_orderpriority AS type, year(o_orderdate) AS year FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


def _docs(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return x.select(F.col("o_orderkey").alias("doc"), F.col("n_name").alias("repo"), F.col("o_orderpriority").alias("type"), F.year("o_orderdate").alias("year"))


def _doc_authors(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("author"))


def _doc_topics(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x, docs = x.select(F.col("l_orderkey").alias("doc"), F.col("p_type").alias("keyword")), _docs(spark, sf_dir)
    # Dealt by document once, for the join and what is distinct by document after it.
    parts = parts_of(x.join(docs, "doc"))
    return x.repartition(parts, "doc").join(docs.repartition(parts, "doc"), "doc")


@query(f"SELECT year, count(*) AS n FROM {_DOC} WHERE year BETWEEN 1950 AND 2030 GROUP BY year")
def year_histogram(spark, sf_dir):
    return G.counts(_docs(spark, sf_dir), G.sane_year()).where("scope = 'global'").select(F.col("v").alias("year"), "n")


#: Order priorities stand for the types of documents.
_KINDS = {"1-URGENT": "Master thesis", "2-HIGH": "journal article", "3-MEDIUM": "book chapter", "4-NOT SPECIFIED": "Ponencia"}


@query(f"""SELECT scope, type, count(*) AS n FROM (SELECT unnest(['global', 'repo:' || repo]) AS scope,
CASE type WHEN '1-URGENT' THEN 'Tesis' WHEN '2-HIGH' THEN 'Artículo' WHEN '3-MEDIUM' THEN 'Libro' WHEN '4-NOT SPECIFIED' THEN 'Conferencia / Ponencia' ELSE 'Documento Académico' END AS type FROM {_DOC}) GROUP BY scope, type""")
def type_distribution(spark, sf_dir):
    kind = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in _KINDS.items()], F.col("type"))
    return G.counts(_docs(spark, sf_dir), T.statistics_type(kind)).select("scope", F.col("v").alias("type"), "n")


@query(f"SELECT repo, count(*) AS n FROM {_DOC} GROUP BY repo")
def top_repositories(spark, sf_dir):
    return G.counts(_docs(spark, sf_dir), F.col("repo")).where("scope = 'global'").select(F.col("v").alias("repo"), "n")


@query("SELECT keyword, n FROM (SELECT trim(p_type) AS keyword, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ORDER BY n DESC, keyword LIMIT 15")
def top_keywords(spark, sf_dir):
    x = G.topic_counts(_doc_topics(spark, sf_dir).select("repo", F.array("keyword").alias("keywords"))).where("scope = 'global'")
    return x.select(F.col("v").alias("keyword"), "n").orderBy(F.col("n").desc(), "keyword").limit(15)


@query(f"""SELECT CASE WHEN grouping(repo) = 1 THEN 'global' ELSE 'repo:' || repo END AS scope, count(*) AS documents, min(year) AS year_min, max(year) AS year_max FROM {_DOC} GROUP BY GROUPING SETS ((repo), ())""")
def stats_grouping_sets(spark, sf_dir):
    d = _docs(spark, sf_dir).select("repo", "type", "year", F.lit(None).cast("string").alias("file"), F.lit(False).alias("has_fulltext"), F.lit(0).alias("reference_count"), F.array("type").alias("keywords"))
    return G.statistics(d).select("scope", "documents", "year_min", "year_max")


@query("SELECT a, b, count(*) AS weight FROM (SELECT DISTINCT x.l_orderkey, x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey) GROUP BY a, b")
def coauthor_edges(spark, sf_dir):
    return G.coauthor_edges(_doc_authors(spark, sf_dir))


_EDGES = "e AS (SELECT a, b, count(*) AS weight FROM (SELECT DISTINCT x.l_orderkey, x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey) GROUP BY a, b)"


@query(f"WITH {_EDGES} SELECT a, b, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS rank FROM e) WHERE rank <= 5")
def coauthors_topk(spark, sf_dir):
    return G.top_coauthors(G.coauthor_edges(_doc_authors(spark, sf_dir)), 5).select("a", "b", "weight", "rank")


@query(f"""WITH {_EDGES}, m AS (SELECT s_suppkey AS author, s_nationkey AS grp FROM supplier),
t AS (SELECT m.grp, e.b, sum(weight) AS weight FROM e JOIN m ON m.author = e.a JOIN m o ON o.author = e.b WHERE o.grp <> m.grp GROUP BY m.grp, e.b)
SELECT grp, b, weight::BIGINT AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, b) AS rank FROM t) WHERE rank <= 10""")
def group_coauthors(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("grp"))
    return G.group_coauthors(G.coauthor_edges(_doc_authors(spark, sf_dir)), m, 10).select("grp", "b", "weight", "rank")


@query(f"WITH {_EDGES} SELECT '1' AS source, b::VARCHAR AS target, weight FROM e WHERE a = 1 ORDER BY weight DESC, b LIMIT 15")
def author_network_1hop(spark, sf_dir):
    edges = G.coauthor_edges(_doc_authors(spark, sf_dir).withColumn("author", F.col("author").cast("string")))
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "weight")
    return G.author_network(1, e)[1].select("source", "target", "weight")


_TAG = "regexp_replace(lower(trim({})), '[^\\p{{L}}\\p{{N}}]+', '_', 'g')"


@query(f"SELECT DISTINCT {_TAG.format('p_type')} AS tag, repo, doc FROM lineitem JOIN part ON p_partkey = l_partkey JOIN {_DOC} d ON d.doc = l_orderkey WHERE length(trim(p_type)) >= 3")
def topic_docs(spark, sf_dir):
    return G.topic_docs(_doc_topics(spark, sf_dir))


@query(f"SELECT DISTINCT {_TAG.format('p_type')} AS tag, y.l_suppkey AS author FROM lineitem x JOIN part ON p_partkey = x.l_partkey JOIN lineitem y ON y.l_orderkey = x.l_orderkey WHERE length(trim(p_type)) >= 3")
def topic_authors(spark, sf_dir):
    return G.topic_authors(G.topic_docs(_doc_topics(spark, sf_dir)).select("tag", "doc").distinct(), _doc_authors(spark, sf_dir))


@query(f"SELECT DISTINCT {_TAG.format('p_type')} AS tag, y.l_suppkey AS author FROM lineitem x JOIN part ON p_partkey = x.l_partkey JOIN lineitem y ON y.l_orderkey = x.l_orderkey JOIN supplier ON s_suppkey = y.l_suppkey WHERE length(trim(p_type)) >= 3 AND s_nationkey = 3")
def topic_repo_authors_semi(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("author"))
    return G.topic_authors(G.topic_docs(_doc_topics(spark, sf_dir)).select("tag", "doc").distinct(), _doc_authors(spark, sf_dir), own)


@query("SELECT s_nationkey AS grp, l_orderkey AS doc, CASE WHEN max(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END) = 1 THEN 'contributor' ELSE 'creator' END AS role FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def author_docs_union_distinct(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") > 1, "contributor").otherwise("creator").alias("role"))
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("grp"))
    return G.author_documents(docs, m)


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity <= 25")
def harvest_dedup_antijoin(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return R.append_new(x.where("l_quantity <= 25"), x.where("l_quantity > 25").select("l_suppkey", "l_partkey"), ("l_suppkey", "l_partkey"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_write_wins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""WITH m AS (SELECT l_suppkey AS author, l_orderkey * 10 + l_linenumber AS seq, l_shipmode FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)),
f AS (SELECT author, l_shipmode AS flag, min(seq) AS seen FROM m GROUP BY 1, 2), c AS (SELECT author, arg_min(l_shipmode, seq) AS role, count(*) AS doc_count FROM m GROUP BY author)
SELECT c.author, role, doc_count, array_to_string(list(flag ORDER BY r) FILTER (WHERE r <= 2), ',') AS flags FROM c JOIN (SELECT *, row_number() OVER (PARTITION BY author ORDER BY seen, flag) AS r FROM f) f ON f.author = c.author GROUP BY 1, 2, 3""")
def author_profile_rollup(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("author"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("role"), F.col("l_returnflag").alias("flag"))
    return G.raw_profiles(m, {"flag": 2}).select("author", "role", "doc_count", F.array_join("flags", ",").alias("flags"))


@query("SELECT s_name AS name, lpad((('0x' || substr(sha256(s_name || chr(31) || s_nationkey), 1, 8))::BIGINT % 10000)::VARCHAR, 4, '0') AS id FROM supplier")
def id_short_hash(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), T.short_hash(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("id"))


@query()
def raw_id_disambiguation(spark, sf_dir):
    return P.raw_ids(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))


@query(f"SELECT p_partkey, {_TAG.format('p_name')} AS tag, CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) || ' ' || split_part(p_name, ' ', 1) ELSE p_name END AS swapped FROM part")
def key_normalise(spark, sf_dir):
    comma = F.concat_ws(", ", F.substring_index("p_name", " ", 1), F.when(F.col("p_name").contains(" "), F.regexp_extract("p_name", r"^\S+ (.*)$", 1)))
    return table(spark, sf_dir, "part").select("p_partkey", T.tag_key(F.col("p_name")).alias("tag"), T.name_swap(comma).alias("swapped"))


_QG = "list_distinct(list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda i: substr('^' || w || '$', i, 4)))"


@query(f"""WITH w AS (SELECT DISTINCT unnest({TOKENS.format("text")}) AS w FROM benchmark), g AS (SELECT w, {_QG} AS g FROM w),
x AS (SELECT w, len(g) AS n, unnest(g) AS q FROM g), p AS (SELECT a.w AS a, b.w AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS i FROM x a JOIN x b ON a.q = b.q AND a.w < b.w GROUP BY 1, 2)
SELECT a, b, round(i / (an + bn - i), 6) AS sim FROM p WHERE i / (an + bn - i) >= 0.3""")
def qgram_jaccard_pairs(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w"))
    return P.qgram_pairs(w, 0.3).select("a", "b", F.round("sim", 6).alias("sim"))


def _words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("given"))


# DuckDB's edit distance counts bytes: each accented letter of the benchmark gets a capital, which no token has, in its place.
_WORDS = f"w AS (SELECT token, translate(token, 'ßäçèéêíñóöü', 'ABCDEFGHIJK') AS one, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM benchmark) GROUP BY token)"
_NEAR = "abs(length(a.one) - length(b.one)) <= 1 AND damerau_levenshtein(a.one, b.one) <= 1"


@query(f"WITH {_WORDS} SELECT a.token, b.token AS other FROM w a JOIN w b ON a.token <> b.token AND {_NEAR}")
def osa_neighbours_r1(spark, sf_dir):
    return P.neighbours(_words(spark, sf_dir)).select("token", "other")


@query(f"WITH {_WORDS} SELECT a.token, arg_min(b.token, struct_pack(m := -b.n, t := b.token)) AS corrected FROM w a JOIN w b ON a.token <> b.token AND a.n <= 1 AND b.n >= 2 AND {_NEAR} GROUP BY a.token")
def token_correction(spark, sf_dir):
    return P.corrections(_words(spark, sf_dir)).select("token", "corrected")


@query("SELECT split_part(p_name, ' ', 2) AS key, count(*) AS n FROM (SELECT DISTINCT p_name FROM part) GROUP BY 1")
def surname_blocks(spark, sf_dir):
    return P.surname_blocks(P.name_parts(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))))


@query()
def components(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem")
    return connected_components(e.select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")))


def _people(spark, sf_dir):
    """Names made of parts' name words: a given word, sometimes as an initial, and two surnames."""
    w = F.split("p_name", " ")
    name = F.concat_ws(" ", F.initcap(F.when(F.col("p_partkey") % 3 == 0, F.substring(w[0], 1, 1)).otherwise(w[0])), F.initcap(F.element_at(w, -1)), F.initcap(F.substring_index("p_type", " ", 1)))
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct()


@query()
def signature_groups(spark, sf_dir):
    return P.signatures(P.name_parts(_people(spark, sf_dir))).select("rep", F.size("members").alias("n"))


@query()
def precision_clusters(spark, sf_dir):
    return P.precision_clusters(_people(spark, sf_dir))


@query()
def impute_proposals(spark, sf_dir):
    return P.impute_initials(P.precision_clusters(_people(spark, sf_dir), correct=False))


@query("SELECT s_nationkey AS grp, arg_min(s_name, struct_pack(a := -s_acctbal, b := s_name)) AS leader FROM supplier GROUP BY 1")
def leader_choice(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("doc_count"))
    return P.choose_leaders(m)


@query(f"""WITH t AS (SELECT unnest({TOKENS.format("p_name")}) AS w FROM part), f AS (SELECT w, count(*) AS n FROM t GROUP BY w),
b AS (SELECT DISTINCT substr(w, 1, 2) || '?' || substr(w, 4) AS word FROM t WHERE length(w) >= 5),
h AS (SELECT word, w, n FROM b JOIN f ON length(w) = length(word) AND substr(w, 1, 2) = substr(word, 1, 2) AND substr(w, 4) = substr(word, 4))
SELECT word, arg_min(w, struct_pack(a := -n, b := w)) AS repaired FROM h GROUP BY word""")
def lost_letter_repair(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(T.tokens(F.col("p_name"))).alias("word"))
    broken = w.where(F.length("word") >= 5).select(F.concat(F.substring("word", 1, 2), F.lit("?"), F.substring("word", 4, 100)).alias("word"))
    return P.lost_letters(w.unionByName(broken))


_PAPERS = "html || '<a href=\"/privacy-notice.pdf\">x</a><a href=\"' || CASE page_id % 3 WHEN 0 THEN '/files/' WHEN 1 THEN 'https://x.org/' ELSE 'sub/' END || page_id || CASE page_id % 2 WHEN 0 THEN '.PDF?d=1' ELSE '.docx' END || '\">y</a><a href=\"/z.pdf\">'"


@query(f"""SELECT page_id AS key, CASE WHEN href LIKE '%://%' THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || href ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || href END AS link
FROM (SELECT page_id, url, list_filter(regexp_extract_all({_PAPERS}, '(?i)href\\s*=\\s*["'']([^"''?#]+)', 1), lambda x: regexp_matches(x, '(?i)\\.(pdf|doc|docx|odt|txt|html|htm|epub)$') AND NOT regexp_matches(x, '(?i)privacidad|privacy|licen[cs]'))[1] AS href FROM pages WHERE url IS NOT NULL) WHERE href IS NOT NULL""")
def link_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url is not null")
    kind = F.when(F.col("page_id") % 3 == 0, "/files/").when(F.col("page_id") % 3 == 1, "https://x.org/").otherwise("sub/")
    link = F.concat(F.lit('<a href="/privacy-notice.pdf">x</a><a href="'), kind, F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".PDF?d=1").otherwise(".docx"), F.lit('">y</a><a href="/z.pdf">'))
    return R.document_links(pages.withColumn("html", F.concat("html", link)), "page_id", "url", "html")


def _scored(tokens: str, source: str, question: str, min_df: int = 1) -> str:
    """SQL of BM25 scores s(key, score) of one question over ``source`` (key, text)."""
    return f"""WITH x AS ({source}), qt AS (SELECT DISTINCT unnest({tokens.format("'" + question + "'")}) AS term),
p AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest({tokens.format("text")}) AS term FROM x) GROUP BY key, term),
l AS (SELECT key, sum(tf) AS len FROM p GROUP BY key), t AS (SELECT term, count(*) AS df FROM p GROUP BY term HAVING count(*) >= {min_df}), n AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
s AS (SELECT p.key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM p JOIN qt USING (term) JOIN t USING (term) JOIN l ON l.key = p.key, n GROUP BY p.key)"""


_AUTHOR = "SELECT 'p' || p_partkey AS key, p_name || ' . ' || CASE WHEN len(w) < 2 THEN p_name ELSE array_to_string(list_transform(w[1:-2], lambda x: substr(x, 1, 1)), ' ') || ' ' || w[-1] END AS text FROM (SELECT p_partkey, p_name, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w FROM part)"


def _authors(spark, sf_dir):
    """Parts as authors: brand and type as keywords, the maker as repository."""
    x = table(spark, sf_dir, "part")
    none = F.expr("cast(array() as array<string>)")
    return x.select(F.concat(F.lit("p"), "p_partkey").alias("consolidated_id"), F.col("p_name").alias("name"), F.lit("Autor").alias("role"), F.col("p_size").alias("doc_count"), F.array("p_name").alias("raw_names"), F.array("p_brand").alias("repos"), none.alias("coauthors"), F.array("p_brand", "p_type").alias("keywords"), none.alias("topic_texts"), none.alias("cited_references"))


_Q_AUTHOR = "hot gear"


@query(_scored(TOKENS, _AUTHOR, _Q_AUTHOR) + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank FROM s) SELECT key AS consolidated_id, p_name AS name, p_size AS doc_count, score, rank, (SELECT max(rank) FROM r) > 20 AS has_more FROM r JOIN part ON key = 'p' || p_partkey WHERE rank <= 20")
def search_authors(spark, sf_dir):
    a = _authors(spark, sf_dir)
    return A.search_authors(a, A.name_index(a), {"q": _Q_AUTHOR}, 20).select("consolidated_id", "name", "doc_count", "score", "rank", "has_more")


@query(_scored(TOKENS, _AUTHOR, _Q_AUTHOR) + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank FROM s JOIN part ON key = 'p' || p_partkey WHERE p_brand = 'Brand#1') SELECT key AS consolidated_id, score, rank FROM r WHERE rank <= 20")
def search_authors_repo(spark, sf_dir):
    a = _authors(spark, sf_dir)
    return A.search_authors(a, A.name_index(a), {"q": _Q_AUTHOR}, 20, 0, "Brand#1").select("consolidated_id", "score", "rank")


_REFS = "SELECT conv_id AS key, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
_REF_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(regexp_replace({}, 'https?://\\S+|www\\.\\S+', ' url ', 'g')), '\\p{{N}}+', '0', 'g'), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _cited(spark, sf_dir):
    """Conversations as documents, their turns as references."""
    r = F.struct("turn", F.col("text").alias("text"))
    x = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_sort(F.collect_list(r)).alias("references"))
    return x.select("key", F.lit("r").alias("repo"), F.lit("").alias("title"), F.lit("").alias("creator"), F.lit("").alias("description"), "references")


@query(_scored(_REF_TOKENS, _REFS, Q["q1"], 5) + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank FROM s), c AS (SELECT conv_id, count(*) AS total_references FROM conversations GROUP BY conv_id) SELECT key, total_references, score, rank FROM r JOIN c ON conv_id = key WHERE rank <= 10")
def search_references(spark, sf_dir):
    d = _cited(spark, sf_dir)
    return C.search_references(d, C.reference_index(d), {"q": Q["q1"]}).select("key", F.col("total_references").cast("long").alias("total_references"), "score", "rank")


@query("SELECT conv_id AS key, turn AS ref_num, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def document_references(spark, sf_dir):
    d = table(spark, sf_dir, "conversations")
    first = d.agg(F.min("conv_id")).first()[0]
    stored = d.select(F.col("conv_id").alias("key"), F.col("turn").alias("ref_num"), "text")
    return C.document_references(_cited(spark, sf_dir), first, stored)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_topk(spark, sf_dir)
