import pytest

from folioforge.llm import htmlextract

TOP = "<div class=top>Our site since 1990</div>"


def body(form, title, parts):
    p = "".join(f"<p>{x}</p>" for x in parts)
    return {
        "wrapped article": f"<div><article><h1>{title}</h1>{p}</article></div>",
        "body in div": f"<article><h1>{title}</h1><div>{p}</div></article>",
        "body in list": f"<article><h1>{title}</h1><ul>{p.replace('p>', 'li>')}</ul></article>",
        "no article": f"<div class=text><h1>{title}</h1>{p}</div>",
    }[form]


@pytest.mark.parametrize("form", ["wrapped article", "body in div", "body in list", "no article"])
def test_copied_pages_keep_their_article(spark, form):
    say = lambda k: [f"Part {j} of story {k} is told here." for j in range(4)]
    own = [("Copied", say("c"))] * 12 + [(f"Title {k}", say(k)) for k in range(24)]
    rows = [(k, f"http://h.org/{k}", f"<body>{TOP}{body(form, t, p)}<div>Rights of all</div></body>") for k, (t, p) in enumerate(own)]
    got = htmlextract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {k: "\n".join([t, *p]) for k, (t, p) in enumerate(own)}


def test_most_of_a_page_is_not_template_as_a_whole():
    html = "<div><p>one one</p><p>two two</p></div><div>Foot</div>"
    root = htmlextract.parse(html)
    htmlextract.subtree_hashes(root)
    outer, foot = (k.hash for k in root.kids)
    assert htmlextract.main_text(html, {outer, foot}) == "one one\ntwo two"
