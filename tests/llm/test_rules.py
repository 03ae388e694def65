import pytest

from folioforge.llm import urlfilter


@pytest.mark.parametrize("most", [0, 500])
def test_rule_without_slash(spark, monkeypatch, most):
    """The same verdicts by joins and by literals."""
    monkeypatch.setattr(urlfilter, "INLINE_RULES", most)
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(["http://bad.net", "http://bad.net?x", "http://www.BAD.net/y", "http://notbad.net/"])], "page_id long, url string, html string")
    rules = spark.createDataFrame([("bad.net", "block")], "rule string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {0: ("bad.net", "block"), 1: ("bad.net", "block"), 2: ("bad.net", "block"), 3: (None, "allow")}
