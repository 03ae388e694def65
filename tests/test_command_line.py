import json

import pytest

from folioforge.__main__ import main
from folioforge.plans import shared
from folioforge.sources import records as R


def record(n, title, who, year):
    xml = f"<r><title>{title}</title><creator>{who}</creator><type>thesis</type><date>{year}</date><subject>rivers ; water</subject></r>"
    return json.dumps({"id": str(n), "xml": xml, "status": "ok"})


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("line")
    for repo, titles in {"r1": ["Salmon of northern rivers", "Trout of southern rivers"], "r2": ["Salmon farms", "Bridges"]}.items():
        (root / f"data/repo={repo}").mkdir(parents=True)
        (root / f"data/repo={repo}/metadata.jsonl").write_text("\n".join(record(k, t, "Gil, Ana", 2000 + k) for k, t in enumerate(titles)) + "\nnot json\n")
    return ["--data", str(root / "data"), "--index", str(root / "index")]


def said(capsys, *args):
    capsys.readouterr()
    code = main([str(a) for a in args])
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_before_the_index_is_built(folders, capsys):
    assert said(capsys, *folders, "search", "salmon") == (1, [])


def test_build_and_search(folders, capsys):
    for _ in range(2):  # the second build replaces the first
        assert said(capsys, *folders, "prepare-index") == (0, [])
    code, rows = said(capsys, *folders, "search", "Salmon")
    assert code == 0 and {r["key"] for r in rows} == {"r1:0", "r2:0"} and [r["rank"] for r in rows] == [1, 2] and rows[0]["score"] >= rows[1]["score"] > 0
    assert [r["key"] for r in said(capsys, *folders, "search", "salmon", "--repo", "r2")[1]] == ["r2:0"]
    assert {r["key"] for r in said(capsys, *folders, "search", "rivers", "--year-min", 2001)[1]} == {"r1:1", "r2:1"}
    assert said(capsys, *folders, "search", "salmon", "-k", 1)[1][0]["has_more"] is True
    assert said(capsys, *folders, "search", "unheard")[1] == []


def test_similar_status_info(folders, capsys):
    main([*folders, "prepare-index"])
    rows = said(capsys, *folders, "similar", "r1:0")[1]
    assert rows and "r1:0" not in {r["key"] for r in rows}
    assert said(capsys, *folders, "status")[1] == [{"repo": "r1", "records": 2, "files": 0}, {"repo": "r2", "records": 2, "files": 0}]
    info = said(capsys, *folders, "info")[1]
    assert [(r["scope"], r["documents"]) for r in info] == [("global", 4), ("repo:r1", 2), ("repo:r2", 2)]


def test_authors_references_and_http(spark, folders, capsys):
    import threading
    import urllib.request

    from folioforge.server import answer, serve

    main([*folders, "prepare-index"])
    assert said(capsys, *folders, "authors", "ana")[0] == 1  # not built yet
    for _ in range(2):  # ids stay
        assert said(capsys, *folders, "consolidate-authors") == (0, [])
        got = said(capsys, *folders, "authors", "ana gil")[1]
        assert [(r["name"], r["doc_count"]) for r in got] in ([("Ana Gil", 8)], [("Gil, Ana", 8)])
    assert said(capsys, *folders, "references", "anything") == (0, [])
    assert said(capsys, *folders, "document", "r1:0")[1][0]["title"] == "Salmon of northern rivers" and said(capsys, *folders, "document", "r9:0") == (0, [])
    assert said(capsys, *folders, "stats", "--repo", "r2")[1][0]["documents"] == 2 and "r9" in said(capsys, *folders, "stats", "--repo", "r9")[1][0]["error"]
    index = folders[-1]
    status, body = answer(spark, index, "/api/search?q=salmon&top=1&year_min=x&repo=all")
    assert status == 200 and body["has_more"] and body["total_hits"] == 1
    assert answer(spark, index, "/api/search")[0] == 400 and answer(spark, index, "/none")[0] == 404 and answer(spark, f"{index}-none", "/api/info")[0] == 500
    server = serve(spark, index, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/document?repo=r2&id=1") as r:
        assert json.loads(r.read())["hits"][0]["title"] == "Bridges"
    server.shutdown()


def test_harvest_into(spark, tmp_path):
    page = lambda ids, token="": "<O><ListRecords>" + "".join(f"<record><header><identifier>{i}</identifier></header></record>" for i in ids) + f"<resumptionToken>{token}</resumptionToken></ListRecords></O>"
    asked = []

    def get(url):
        asked.append(url)
        if "bad" in url:
            raise OSError("gone")
        return page("ab" if "from" not in url else "bc")

    ends = {"r1": "http://one/oai", "r2": "http://bad/oai"}
    told = lambda now, **k: [(r.repo, r.new, r.error is None) for r in R.harvest_into(spark, ends, str(tmp_path / "d"), now, get=get, **k).collect()]
    assert told("2021-01-01") == [("r1", 2, True), ("r2", 0, False)]
    assert told("2021-02-01") == [("r1", 1, True), ("r2", 0, False)]
    assert told("2021-03-01", incremental=False) == [("r1", 0, True), ("r2", 0, False)]
    assert sorted((r.repo, r.id) for r in R.records(spark, str(tmp_path / "d")).collect()) == [("r1", "a"), ("r1", "b"), ("r1", "c")]
    assert [r.since for r in R.read_jsonl(spark, str(tmp_path / "d/_cursors"), "repo string, since string").collect()] == ["2021-03-01"]


def test_clean(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")  # other tests' tables are elsewhere
    kept = shared.save(spark.range(3).toDF("a"), "clean-test")
    assert shared.forget_older(spark, 1) == [] and kept.count() == 3
    assert shared.forget_older(spark, 0) == [kept._folio_path.rsplit("/", 1)[1]] and shared.forget_older(spark, 0) == []
