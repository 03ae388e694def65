import random

import corpus_pipeline
from folioforge.llm import linededup


def test_near_copies_keep_their_passage(spark):
    """Two near-copy groups of a host, a third and a twelfth of it, under a menu that all pages have."""
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}

    def add(lines):
        rows.append((len(rows), "\n".join(["home news contact", *lines]), "en", "h", 1))
        want[len(want)] = "\n".join(lines)

    for size in (30, 8):
        passage = [say(12) for _ in range(10)]
        for k in range(size):
            at = k % 10
            add([*passage[:at], passage[at].rsplit(" ", 1)[0] + f" edit{k}", *passage[at + 1 :]])
    for _ in range(52):
        add([say(12) for _ in range(6)])
    add([say(12)])  # little text under the menu
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.line_stage(spark, docs, "")
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert linededup.drop_boilerplate(docs.limit(0), copies="fold").collect() == []
