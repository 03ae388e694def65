import hashlib
import json
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from folioforge.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.WordBpe(path), tokenizers.Tokenizer.from_file(path)


ODD = ["", " ", "Hello, World!  it's we'll", "<|endoftext|>a<|startoftext|> <|endoftext|>", "ÀÉîõü ΣΑΣ ΟΔΟΣ σς", "é Å", "日本語テキスト 123 4.5", "İstanbul", "a\u0085b c d​e\x1cf\x1fg", "🙂👩‍👩‍👧 ok", "x" * 3000, "ab" * 700, "don't'S'T", "\x00\x01", "１２３ Ⅷ ½", "a_b__c--d", "''re'RE", "ﬁ ﬀ ß ẞ Ǆ", "<|endoftext", "نص عربي", "हिन्दी पाठ"]


@pytest.mark.parametrize("text", ODD)
def test_as_the_library(both, text):
    own, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == lib.decode(want, skip_special_tokens=False)
    n, a, b = own.digests(text)
    assert n == len(want)
    assert a == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert b == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_random_texts(both):
    own, lib = both
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABC ÄÖÜéñçΣσ'-.,!?0123456789\n\t日本🙂"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def brute_merge(ranks, parts):
    """Without boundaries: the leftmost pair of lowest rank is joined, again and again."""
    while True:
        known = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not known:
            return parts
        k = min(known)[1]
        parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]


@pytest.mark.parametrize("scan_most", [10**9, 0])
def test_scan_and_heap_against_brute_force(both, monkeypatch, scan_most):
    own, _ = both
    monkeypatch.setattr(bpe, "SCAN_MOST", scan_most)
    rng = random.Random(6)
    for size in [1, 2, 3, *(rng.randrange(2, 120) for _ in range(120))]:
        word = "".join(rng.choice("abcdeingthr") for _ in range(size))
        symbols = word + own.end
        bounds = own.merge(symbols, [*range(size), len(symbols)])
        assert [symbols[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] == brute_merge(own.ranks, [*word[:-1], word[-1] + own.end])
        assert bounds[0] == 0 and bounds[-1] == len(symbols) and bounds == sorted(set(bounds))


def test_other_files_are_refused(tmp_path):
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="added tokens"):
        bpe.WordBpe(str(tmp_path / "x.json"))


def test_cache_is_bounded(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    text = "one two three four five one two six seven eight nine ten one"
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello there", 5), (2, None, 6), (None, "", 7), (1, "Hello there", 5)], "doc_id long, text string, n_tokens long")
    rows = bpe.token_digests(df).collect()
    assert len(rows) == 4 and sorted(r.n_tokens for r in rows) == [0, 0, 2, 2]
    assert bpe.token_digests(df.limit(0)).collect() == []
    assert {len(r.ids) for r in bpe.encode_documents(df).collect()} == {0, 2}
