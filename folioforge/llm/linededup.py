"""Line deduplication by site-relative frequency, in DataFrame functions only.

Pages are grouped by host; for each line the pages of the host that contain it are divided by the host's pages, and
lines above a ratio are dropped.  Only 64-bit line hashes are shuffled, pre-summed, and most lines leave before
they meet their host's total.  A host has at most (lines per page / ratio) dropped lines, so these travel as one
array per host, which is broadcast if the table is small by count and else joined by host, where Spark splits a
hot host.

Near copies of one page would make its own lines look like boilerplate.  With ``copies="fold"`` pages of which
nearly all word pairs stand in a host's frequent lines are copies; a host's copies count as one page together, and
lines are counted again until no page becomes a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, save

RATIO = 0.02
MIN_PAGES = 10
COPY = 0.9  # of a page's word pairs: two pages that share so much are near duplicates (0.9 / 1.1 > 0.8)
BROADCAST_LINES = 500_000  # 8 bytes each


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")


def _distinct_lines() -> Column:
    return F.array_distinct(F.filter(F.transform(_lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != ""))


def _pairs(lines: Column) -> Column:
    """Distinct hashes of the word pairs inside each of some lines; of a line of one word, the word's."""
    words = F.transform(lines, lambda x: F.split(x, r"\s+"))
    pairs = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 2))))
    return F.array_distinct(F.flatten(pairs))


def boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: DataFrame | None = None) -> DataFrame:
    """(host, lines array<long>): hashes of the lines that stand in at least ``min_pages`` pages of the host and in
    more than ``ratio`` of them.  Lines are compared without outer blanks; blank lines don't count.  A null host is
    a host of its own, named ''.  Pages of a host listed in ``copies`` (host, page) are one page together."""
    h = _host(host)
    if copies is None:
        seen = pages.select(h, F.explode_outer(_distinct_lines()).alias("line")).where("line is not null").groupBy("host", F.xxhash64("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))
        total = pages.select(h).groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    else:
        hashed = pages.select(h, F.xxhash64("text").alias("page"), F.transform(_distinct_lines(), lambda x: F.xxhash64(x)).alias("lines"))
        mark = copies.withColumn("copy", F.lit(1))
        marked = hashed.join(mark, ["host", "page"], "left").withColumn("copy", F.coalesce("copy", F.lit(0)))
        once = F.sum(1 - F.col("copy")) + F.max("copy")
        seen = marked.select("host", "copy", F.explode("lines").alias("line")).groupBy("host", "line").agg(once.alias("n"))
        total = hashed.select("host", "page").join(mark, ["host", "page"], "left").withColumn("copy", F.coalesce("copy", F.lit(0))).groupBy("host").agg(once.alias("total"))
    often = seen.where(F.col("n") >= min_pages).join(total, "host").where(F.col("n") > ratio * F.col("total"))
    return often.groupBy("host").agg(F.collect_set("line").alias("lines"))


def copied_pages(pages: DataFrame, bad: DataFrame, host: str = "source") -> DataFrame:
    """(host, page): hashes of the texts of which ``COPY`` of the word pairs stand in lines of ``bad``."""
    own = pages.select(_host(host), F.xxhash64("text").alias("page"), _distinct_lines().alias("own")).join(bad, "host")
    held = F.filter("own", lambda x: F.array_contains(F.col("lines"), F.xxhash64(x)))
    own = own.select("host", "page", "own", held.alias("held")).where(F.size("held") > 0)
    texts = own.select("host", F.explode("held").alias("line")).distinct()
    pairs = texts.select("host", F.explode(_pairs(F.array("line"))).alias("p")).groupBy("host").agg(F.collect_set("p").alias("common"))
    paired = own.select("host", "page", _pairs(F.col("own")).alias("pairs")).join(pairs, "host")
    return paired.where(F.size(F.array_intersect("pairs", "common")) >= COPY * F.size("pairs")).select("host", "page").distinct()


def _small(df: DataFrame, values: int) -> DataFrame:
    return F.broadcast(df) if values <= BROADCAST_LINES else df


def folded_boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """As :func:`boilerplate`, a host's copied pages counted as one.  Each round finds the copies that the lines of
    the round before show: a smaller group stands out once the larger is folded."""
    bad, copies, n = save(boilerplate(pages, host, ratio, min_pages), "boilerplate"), None, 0
    while size := bad.agg(F.sum(F.size("lines") + 2)).first()[0]:
        found = copied_pages(pages, _small(bad, size), host)
        found = save(found if copies is None else found.unionByName(copies).distinct(), "copies")
        more = found.count()
        if more == n:
            break
        copies, n = found, more
        bad = save(boilerplate(pages, host, ratio, min_pages, _small(copies, 2 * n)), "boilerplate")
    return bad


def drop_boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, whole_pages: str = "drop", copies: str = "count") -> DataFrame:
    """``pages`` with ``text`` free of boilerplate lines, and n_lines, n_dropped (long).

    Null text stays null and has no lines; empty text has one blank line, which is kept.  With
    ``whole_pages="keep"`` a page none of whose lines would be left is returned as it was: such pages are copies
    of a page rather than pages with boilerplate.  Repeated rows count as pages, unless ``copies="fold"``: then a
    host's pages that are nearly all frequent lines count as one.
    """
    bad = folded_boilerplate(pages, host, ratio, min_pages) if copies == "fold" else save(boilerplate(pages, host, ratio, min_pages), "boilerplate")
    size = bad.agg(F.sum(F.size("lines") + 2)).first()[0] or 0
    key, lines, kept = (fresh(pages, f"folio_{x}") for x in ("host", "lines", "kept"))
    bad = bad.select(F.col("host").alias(key), F.col("lines").alias(lines))
    bad = _small(bad, size)
    out = pages.withColumn(key, F.coalesce(F.col(host).cast("string"), F.lit(""))).join(bad, key, "left")
    good = F.filter(_lines(F.col("text")), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(lines), F.xxhash64(F.trim(x))))
    out = out.withColumn(kept, F.when(F.col(lines).isNull(), _lines(F.col("text"))).otherwise(good))
    if whole_pages == "keep":
        out = out.withColumn(kept, F.when(F.exists(kept, lambda x: F.trim(x) != ""), F.col(kept)).otherwise(_lines(F.col("text"))))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("text")))).cast("long")
    left = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
    return out.withColumn("n_lines", n).withColumn("n_dropped", n - left).withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(kept, "\n"))).drop(key, lines, kept)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
     l AS (SELECT DISTINCT r, host, trim(x, ' ') AS line FROM (SELECT r, host, unnest(ls) AS x FROM d)),
     n AS (SELECT host, line, count(*) AS n FROM l WHERE line <> '' GROUP BY host, line),
     t AS (SELECT host, count(*) AS total FROM d GROUP BY host),
     b AS (SELECT n.host, list(n.line) AS bad FROM n JOIN t ON n.host = t.host WHERE n.n >= 10 AND n.n > 0.02 * t.total GROUP BY n.host),
     o AS (SELECT d.*, list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(bad, []), trim(x, ' '))) AS kept FROM d LEFT JOIN b ON d.host = b.host)
SELECT doc_id, source, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text
FROM o
"""
