import random

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def say():
    rng = random.Random(8)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(300)] for lang, letters in (("en", "abcdefgh"), ("de", "qrstuvwxyzäü"))}
    return lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))


def stage(name):
    return dict(cp.STAGES)[name]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else 0, 1) for i, t, lang, s in rows], SCHEMA)


def key(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_of_edges(spark, say, tmp_path):
    """Null ids, null and empty texts, repeated rows, an empty table and a further column, in every stage."""
    item = say("en", 9)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    a, b = say("en", 60), say("de", 60)
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (None, a, "en", "s"), (None, b, "de", "s"), (None, b, "de", "s"), (2, near, "en", None), (3, None, None, None), (4, "", "en", "s"), (5, "1234 !", "en", "s"), (6, f"{b[:20]} {item} x", None, "s"), (None, f"y {item}", "en", "s"), (8, say("en", 30), "en", "s")]
    rows += [(k, say(lang, 50), lang, "s") for k, lang in enumerate(["en", "de"] * 20, 100)]
    docs = table(spark, rows)
    for name, f in cp.STAGES:
        out = f(spark, docs.limit(0), str(tmp_path))
        assert out.collect() == [] and (name == "bpe" or out.columns == cp.COLUMNS)
    plain = [(i, t) for i, t, *_ in rows]
    spoken = key(stage("language_id")(spark, docs, str(tmp_path)))
    assert spoken == sorted([x for x in plain if x[1] not in (None, "", "1234 !")], key=str)
    assert key(stage("line_dedup")(spark, docs, str(tmp_path))) == sorted(plain, key=str)
    one = key(stage("near_dedup")(spark, docs, str(tmp_path)))
    assert one == sorted({x for x in plain if x not in {(None, a), (2, near)}}, key=str)
    clean = key(stage("decontamination")(spark, docs, str(tmp_path)))
    assert clean == sorted([x for x in plain if item not in (x[1] or "")], key=str)
    assert stage("bpe")(spark, docs, str(tmp_path)).count() == len(rows)


def test_run_against_its_stages(spark, say, tmp_path):
    """Planted cases fall in their stage, everything else comes through with the library's digests."""
    rows = [(k, "\n".join(say(lang, 25) for _ in range(3)), lang, f"s{k % 2}") for k, lang in enumerate(["en", "de"] * 30)]
    item = say("en", 12)
    kept = {k for k, *_ in rows}
    rows += [(200 + k, rows[k][1], "en", "s0") for k in range(5)]  # copies
    rows += [(300, f"{rows[7][1]} {item}", "en", "s1"), (301, say("en", 20) + " " + item, "en", "s1"), (302, "12 34", "en", "s1"), (303, None, None, None)]
    table(spark, rows).drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == kept
    from folioforge.llm import bpe

    own = bpe.WordBpe(bpe.default_path())
    texts = {i: t for i, t, *_ in rows}
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == own.digests(texts[i]) for i, r in got.items())
