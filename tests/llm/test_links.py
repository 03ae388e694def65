from urllib.parse import urljoin

from pyspark.sql import functions as F

from folioforge.llm import urlfilter


def test_relative_targets(spark):
    bases = ["http://Good.org/a/b/c?q=1#f", "https://good.org", "http://good.org/", "http://good.org/a/b/", "http://good.org?q"]
    targets = ["/en/1", "//bad.net/p", "//bad.net", "next.html", "?page=2", "../up/./x", "../../../../x", "./", "..", ".", "/a/b/../../", "sub/..", "http://other.org/x", "x?u=http://y.org/../z", "/go?u=http://y.org", "a:b/c", "/.hidden", "/x/..."]
    rows = [(b, t) for b in bases for t in targets]
    got = spark.createDataFrame(rows, "b string, t string").select("b", "t", urlfilter.resolve(F.col("b"), F.col("t"))).collect()
    assert {(b, t): u for b, t, u in got} == {(b, t): urljoin(b, t) for b, t in rows}
    # urljoin leaves these dots, the standard doesn't
    assert spark.range(1).select(urlfilter.resolve(F.lit("https://good.org"), F.lit("//bad.net/a/../b?x"))).first()[0] == "https://bad.net/b?x"


def test_relative_links_pass_verdicts_on(spark):
    link = lambda href: f"<head><link rel=canonical href='{href}'></head>"
    refresh = "<meta http-equiv=refresh content='0;url=next.html'>"
    rows = [(1, "http://a.org/x", link("//bad.net/p")), (2, "http://a.org/y", link("/x")), (3, "http://a.org/d/z", refresh), (4, "http://a.org/d/next.html", link("../y")), (5, "http://a.org/d/z?p", link("?q")), (6, "http://b.org/", "<base href='//bad.net/'>" + link("p")), (7, "http://c.org/", link("mailto:x")), (8, "nothing", link("/x")), (9, "http://c.org/1", link("#top"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("bad.net/", "block")], "rule string, verdict string")
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow"}
