import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import decontam, hmm, htmlextract, langid, linededup, minhash, omh, urlfilter, warc
from folioforge.llm.common import Words

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ 1 WARC
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "x" * 50, 1), (1, "http://b/\r\nEvil: 1", "x" * 50, 1), (2, None, "", 1), (4, "u", None, 1), (None, "u", "x" * 50, 1), (9, "é", "é\r\n\r\nz", 1), (1, "http://b/", "x" * 50, 1)]
    index = warc.write_archives(pages(spark, rows), frame_bytes=300, bundle_bytes=500)
    got = warc.read_archives(index).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(3, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (4, "revisit", 2), (-1, "revisit", 1), (9, "response", None)], key=lambda r: (r[0], r[1]))
    nine = next(r for r in got if r.page_id == 9)
    assert bytes(nine.payload) == "é\r\n\r\nz".encode() and nine.payload_bytes == 7
    assert nine.payload_digest == warc.digest32("é\r\n\r\nz".encode())
    one = warc.lookup(index, index.where("page_id = 9").select("record_id")).collect()
    assert [r.page_id for r in one] == [9]
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []


def test_warc_ids_and_reading_tasks(spark):
    """Every record has an identifier of its own, repeated and null pages too; each bundle is read by a task of its own."""
    rows = [(1, "http://a/", "x" * 50, 1)] * 3 + [(None, "u", "x" * 50, 1)] * 2 + [(5, "u", "x" * 50, 1)] + [(k, "u", f"page {k} " * 9, 1) for k in range(100, 250)]
    index = warc.write_archives(pages(spark, rows), frame_bytes=100, bundle_bytes=100)
    ids = [r.record_id for r in index.collect()]
    assert len(ids) == len(rows) == len(set(ids))
    names = index.select("bundle").distinct().count()
    got = warc.read_archives(index).withColumn("task", F.spark_partition_id()).collect()
    assert names > 100 and len({r.task for r in got}) == names and {r.record_id for r in got} == set(ids)
    found = warc.lookup(index, index.where("page_id = 1 or page_id = 5").select("record_id")).collect()
    assert sorted(r.page_id for r in found) == [1, 1, 1, 5] and len({r.record_id for r in found}) == 4
    # A pair without repeats: the revisit names its response's record.
    two = warc.write_archives(pages(spark, [(1, "u", "same", 1), (2, "u", "same", 1)]))
    assert two.where("page_id = 1").first().record_id == warc.record_id(1, warc.digest32(b"same"))


@pytest.mark.parametrize("most", [200_000, 0])
def test_warc_revisits_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rows = [(3, "u", "x", 1), (None, "u", "x", 1), (2, "u", "x", 1), (2, "u", "x", 1), (7, "u", None, 1), (8, "u", "", 1), (9, "u", "own", 1)]
    got = sorted((r.page_id or 0, r.refers_to or 0, r.repeated, r.target_repeated) for r in warc.mark_revisits(pages(spark, rows)).collect())
    assert got == [(0, 2, True, True), (2, 0, True, True), (2, 0, True, True), (3, 2, False, True), (7, 0, False, False), (8, 7, False, False), (9, 0, False, False)]


def test_warc_least_bytes(spark):
    rows = [(1, "u", "ab", 1), (2, "u", "ab", 1), (3, "u", "abcd", 1), (4, "u", "abcd", 1)]
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages(spark, rows), least_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# ------------------------------------------------------------------ 2 decontamination
def brute_hits(docs, items, width=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, text in items:
            v = words(text)
            k = min(width, len(v))
            for s in range(max(1, len(v) - width + 1)) if v else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice("ab cd É ef G1 h".split()) for _ in range(n))
    items = [(k, say(rng.randrange(0, 14))) for k in range(8)] + [(8, None), (9, "one")]
    docs = [(k, say(40)) for k in range(30)] + [(30, None), (31, ""), (32, items[3][1] + "!" + items[4][1]), (33, "ONE")]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(d, b, width=4, block_windows=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(brute_hits(docs, items, 4))


def test_decontamination_of_shared_windows_and_large_words(spark, monkeypatch):
    """A window of many items, words of many bytes in small blocks, and columns to carry with the operator's own names."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    big = "z" * 500
    items = [(k, f"a b c d own{k} x y {big if k == 3 else 'q'}") for k in range(40)]
    docs = [(1, "so A b, c d it is", "p"), (2, f"x y {big} and own3 x y {big}", "q"), (None, "a b c d", "r"), (4, "a b c", "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, w string").selectExpr("*", "w as i", "w as h", "w as windows", "w as row", "w as key", "w as rows")
    carry = ("w", "i", "h", "windows", "row", "key", "rows")
    got = decontam.contamination(d, spark.createDataFrame(items, "item_id long, text string"), width=4, carry=carry).collect()
    want = {(r[0], *r[1:3], tuple(r[3])) for r in brute_hits([x[:2] for x in docs], items, 4)}
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got} == want
    assert {r.doc_id: r.w for r in got} == {x[0]: x[2] for x in docs} and all({r[c] for c in carry} == {r.w} for r in got)


def test_decontamination_edges(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.contamination(docs, empty).collect()] == [0] * 7
    assert decontam.contamination(docs.limit(0), empty).collect() == []


# ------------------------------------------------------------------ 3 lines
def test_lines(spark):
    rows = [(k, f"menu\n own {k}\n\n menu ", "h") for k in range(6)] + [(7, None, "h"), (8, "", None), (9, "menu", "other"), (10, "menu", "h")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lines int")
    got = {r.doc_id: r for r in linededup.drop_boilerplate(d, ratio=0.5, min_pages=3).collect()}
    assert got[0].text == " own 0\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2)
    assert got[7].text is None and got[8].text == "" and got[9].text == "menu" and got[10].text == ""
    kept = {r.doc_id: r.text for r in linededup.drop_boilerplate(d, ratio=0.5, min_pages=3, whole_pages="keep").collect()}
    assert kept[10] == "menu" and kept[0] == " own 0\n"
    assert linededup.drop_boilerplate(d.limit(0)).collect() == []


# ------------------------------------------------------------------ 4 language model
def test_words_are_split_and_folded():
    texts = ["Ab  ab\tc\x0b", "", "é É ab"]
    data = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    h = [list(w.hash[a:b]) for a, b in itertools.pairwise(w.bounds)]
    assert [len(x) for x in h] == [3, 0, 3]
    assert h[0][0] == h[0][1] == h[2][2] and len({*h[0], *h[2]}) == 4


def test_forward_is_exact():
    rng = np.random.default_rng(3)
    model = hmm.Hmm(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    seqs = [np.array(s, np.int32) for s in ([0], [4, 1], [2, 2, 3, 0], [1, 0, 4])]
    for s, got in zip(seqs, hmm.log_likelihood(model, seqs), strict=True):
        total = sum(math.prod([model.start[p[0]], *(model.move[a, b] for a, b in itertools.pairwise(p)), *(model.emit[x, k] for x, k in zip(s, p, strict=True))]) for p in itertools.product(range(3), repeat=len(s)))
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)


@pytest.mark.parametrize("block", [150_000, 3, 1])
def test_expected_counts_are_posteriors(monkeypatch, block):
    """In blocks too, as long texts are gone through."""
    rng = np.random.default_rng(4)
    model = hmm.Hmm(rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 3, 2).T)
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", block)
    seqs = [np.array(s, np.int32) for s in ([0, 1, 2, 1], [2, 0], [1, 1, 0])]
    emit = np.zeros((3, 2))
    start, move, log = hmm.expected_counts(model, seqs, emit)
    assert math.isclose(log, hmm.log_likelihood(model, seqs).sum())
    want_s, want_m, want_e = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for s in seqs:
        paths = {p: math.prod([model.start[p[0]], *(model.move[a, b] for a, b in itertools.pairwise(p)), *(model.emit[x, k] for x, k in zip(s, p, strict=True))]) for p in itertools.product(range(2), repeat=len(s))}
        z = sum(paths.values())
        for p, v in paths.items():
            want_s[p[0]] += v / z
            for a, b in itertools.pairwise(p):
                want_m[a, b] += v / z
            for x, k in zip(s, p, strict=True):
                want_e[x, k] += v / z
    assert np.allclose(start, want_s) and np.allclose(move, want_m) and np.allclose(emit, want_e)


def test_scores_against_brute_counts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    d = d.unionByName(spark.createDataFrame([(10**6, None, None, None, None)], d.schema))
    d = d.withColumn("syms", F.lit(1)).withColumn("row", F.lit(2))  # clashing names
    rows = hmm.score_documents(langid.split_by_crc(d, 7, 2), passes=1).collect()
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    tokens = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x] + ["\n"]
    count: dict = {}
    for k, t in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for x in tokens(t):
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(w), n, sum(x in count for x in w))
        assert math.isclose(r.base_score, sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def brute_score(text, count, fitted):
    """log10 probability of a text's words and end by summing over states word by word, from dictionaries."""
    voc, model = fitted.vocabulary, fitted.model
    at = {int(h): i for i, h in enumerate(voc.hashes)}
    p = None
    for w in [*text, None]:
        if w is None:
            symbol, share = at[hmm.END], 1.0
        else:
            data = np.frombuffer(w.encode(), np.uint8)
            one = Words(data, np.array([0, len(data)]))
            symbol, share = at.get(int(one.hash[0])), 1.0
            if symbol is None:
                c = int(hmm.tail_class(one)[0])
                symbol, share = len(voc.hashes) + c, (count.get(w, 0) + 1) / voc.tail_mass[c]
        e = model.emit[symbol].astype(float) * share
        p = model.start * e if p is None else [sum(p[i] * model.move[i, j] for i in range(len(e))) * e[j] for j in range(len(e))]
    return math.log10(sum(p))


def test_score_is_the_probability_of_the_text(spark):
    rng = random.Random(5)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    first, second = "the of and to in river stone".split(), "der die und zu in fluss stein".split()
    texts = [say(rng.choice([first, second]), rng.randrange(1, 25)) + f" rare{k}ly" for k in range(60)] + ["", None, "never seen WORDS The"]
    d = spark.createDataFrame([(k, t, k % 7 == 2) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    fitted = hmm.fit(d, head=9, states=3, passes=2)
    voc, model = fitted.vocabulary, fitted.model
    assert len(voc.hashes) <= 9 and np.allclose(model.emit.astype(float).sum(axis=0), 1, atol=1e-5) and np.allclose(model.move.sum(axis=1), 1)
    count: dict = {}
    words = lambda t: (t or "").lower().split()
    for k, t in enumerate(texts):
        for w in words(t) if k % 7 != 2 else ():
            count[w] = count.get(w, 0) + 1
    for r in hmm.score(fitted).collect():
        assert math.isclose(r.score, brute_score(words(texts[r.doc_id]), count, fitted), rel_tol=1e-5)
    # A state's probabilities of all known words, of the end and of each class's share for unknown ones make one.
    own = sum((count[w] + 1) / voc.tail_mass[int(hmm.tail_class(Words(x, np.array([0, len(x)])))[0])] * model.emit[len(voc.hashes) + int(hmm.tail_class(Words(x, np.array([0, len(x)])))[0])] for w in count if int(Words(x := np.frombuffer(w.encode(), np.uint8), np.array([0, len(x)])).hash[0]) not in {int(h) for h in voc.hashes})
    unknown = (model.emit[len(voc.hashes) :].astype(float) / voc.tail_mass[:, None]).sum(axis=0)
    assert np.allclose(own + unknown + model.emit[: len(voc.hashes)].astype(float).sum(axis=0), 1, atol=1e-5)


def test_training_gains_and_edges(spark, docs):
    d = langid.split_by_crc(spark.read.parquet(f"{SF}/documents.parquet"), 7, 2)
    fitted = hmm.fit(d, passes=0)
    train = fitted.encoded.where("not held_out")
    model, first = hmm.baum_welch_pass(train, fitted.model, fitted.vocabulary.prior())
    second = hmm.baum_welch_pass(train, model, fitted.vocabulary.prior())[1]
    assert second > first
    assert hmm.score_documents(langid.split_by_crc(docs.limit(0), 7, 2)).collect() == []
    alone = hmm.score_documents(docs.withColumn("held_out", F.lit(True))).collect()
    assert len(alone) == 7 and {r.n_known for r in alone} == {0} and all(np.isfinite(r.score) for r in alone)


# ------------------------------------------------------------------ 6 near duplicates
def brute_groups(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[k] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("share", [128, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(minhash, "PAIRS_A_TASK", share)
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(rng.choice([1, 3, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows) + 100, " ".join(t)))
    rows += [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d"), (8, "a b c d")]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean"), width=4)
    want = brute_groups(rows, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def family(n, common, own):
    """Sets that share ``common`` shingles, each with ``own`` of its own."""
    return [(k, [*range(common), *range(10**6 + k * own, 10**6 + (k + 1) * own)], k) for k in range(n)]


def test_template_families_below_the_threshold_do_not_meet(spark):
    """400 shared and 82 own shingles (0.71), and 400 and 51 (0.797): members never meet; at 49 (0.803) they have to."""
    for n in (300, 3000):
        rows = spark.createDataFrame(family(n, 400, 82), "id long, s array<long>, c long")
        assert minhash._prefix_pairs(rows, 80).count() == 0
    near = lambda own: minhash._prefix_pairs(spark.createDataFrame(family(40, 400, own), "id long, s array<long>, c long"), 80).count()
    assert near(51) == 0 and near(49) == 40 * 39 // 2


@pytest.mark.parametrize("share", [1_000_000, 2])
def test_prefix_pairs_miss_nothing(spark, monkeypatch, share):
    monkeypatch.setattr(minhash, "PAIRS_A_SHARE", share)
    rng = random.Random(4)
    sets = []
    for g in range(25):
        base = rng.sample(range(3000), rng.choice([1, 5, 20, 60, 61, 64]))
        for _ in range(6):
            s = set(base) - set(rng.sample(base, min(len(base) - 1, rng.choice([0, 0, 1, 2, 6])))) | set(rng.sample(range(3000), rng.choice([0, 1, 3, 9])))
            sets.append((len(sets), sorted(s), rng.choice([len(sets), g])))
    got = {(r.hub, r.id) for r in minhash._prefix_pairs(spark.createDataFrame(sets, "id long, s array<long>, c long"), 80).collect()}
    similar = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {(i, j) for (i, a, c), (j, b, d) in itertools.combinations(sets, 2) if c != d and similar(set(a), set(b))}
    assert want and want <= got


def test_near_duplicates_of_string_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other"), (None, "other")]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, True)}


def test_near_duplicates_edges(spark, docs):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 7
    assert {r.component_id for r in got if r.doc_id == 1} == {1}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


# ------------------------------------------------------------------ 7 Order MinHash
def xx(*values):
    """Spark's xxhash64 of strings: each is hashed with the hash before it as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed


def long_bytes(x, n=8):
    return int(x).to_bytes(n, "little", signed=x < 0)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_fingerprint(text, at=24):
    """By dictionaries instead of sorted longs: every draw's whole order of the numbered k-mers, round after round."""
    t = re.findall(r"\S{1,16}", text)
    seen, items = {}, []
    for i in range(len(t)):
        h = xx(*t[i : i + 3])
        o = seen.get(h, 0)
        seen[h] = o + 1
        items.append((xxhash.xxh64_intdigest(long_bytes(o, 4), xxhash.xxh64_intdigest(long_bytes(h), 42)), i))
    # Places of the numbered k-mers, by which ties in what is left of a hash go: by hash of the k-mer, then by position.
    place = {i: k for k, (_, i) in enumerate(sorted(((signed(xx(*t[i : i + 3]) >> at << at), i) for i in range(len(t)))))}
    draws = {}
    for r in range(max(1, -(-omh.DRAWS * omh.DEALT // max(1, len(t))))):
        for g, i in items:
            y = xxhash.xxh64_intdigest(long_bytes(r, 4), xxhash.xxh64_intdigest(long_bytes(g), 42))
            draws.setdefault(y >> 58, []).append((r, (y & ((1 << 48) - 1)) >> at, place[i], g, i))
    out = []
    for d in sorted(draws):
        low = []
        for *_, g, i in sorted(draws[d]):
            if (i, g) not in low and len(low) < omh.KEEP:
                low.append((i, g))
        seed = 42
        for _, g in sorted(low):
            seed = xxhash.xxh64_intdigest(long_bytes(g), seed)
        out.append(f"{d:02x}{seed & 0xFFFFFFFF:08x}")
    return " ".join(out)


TEXTS = ["", "one", "a b", "x " * 300, "antidisestablishmentarianism " * 3]


@pytest.mark.parametrize("at", [24, 40])
def test_fingerprint_against_brute_force(spark, monkeypatch, at):
    """With 40 bits for places, as a text of 2^39 tokens would have."""
    monkeypatch.setattr(omh, "AT", at)
    rng = random.Random(7)
    texts = TEXTS + [" ".join(rng.choice("the of and x1 yy zz".split()) for _ in range(rng.choice([3, 9, 40, 200, 900]))) for _ in range(20)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r.k: r.f for r in df.select("k", omh.as_text(omh.fingerprint(F.col("text"))).alias("f")).collect()}
    assert got == {k: brute_fingerprint(t, at) for k, t in enumerate(texts)}


def test_order_matters_and_likeness(spark):
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words), " ".join(words[100:] + words[:100]), " ".join(words[:190] + ["new"] + words[190:]), "", None]
    df = spark.createDataFrame([(texts[0], t) for t in texts], "a string, b string")
    got = [r[0] for r in df.select(omh.likeness(omh.fingerprint(F.col("a")), omh.fingerprint(F.col("b")))).collect()]
    assert got[0] == 1 and got[1] < got[2] < 1 and got[2] > 0.8 and got[3] == got[4] == 0


def test_order_of_short_texts(spark):
    """Halves swapped: an independent order for each draw sees it in short texts too; one edit stays near."""
    rng = random.Random(3)
    rows = []
    for n in (20, 40, 80):
        for _ in range(10):
            w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2]), " ".join(["new", *w[1:]])))
    df = spark.createDataFrame(rows, "n int, a string, b string, c string")
    near = lambda x: F.avg(omh.likeness(omh.fingerprint(F.col("a")), omh.fingerprint(F.col(x))))
    for r in df.groupBy("n").agg(near("b").alias("swapped"), near("c").alias("edited")).collect():
        assert r.swapped < (0.45 if r.n < 80 else 0.55) and r.edited > r.swapped + 0.2


def test_op7_query_against_brute_force(spark, tmp_path):
    rows = [(5, "one two three four"), (1, None), (9, "x" * 7), (3, ""), (4, "é 日本 a b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in omh.op7_order_minhash(spark, str(tmp_path)).collect()}
    order = sorted((k, t or "") for k, t in rows)
    for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own = lambda x: set(x.split())
        for name, other in (("near_edited", r.edited_fingerprint), ("near_next", got[next(i for i, x in rows if (x or "") == after and i != k)].fingerprint)):
            a, b = own(r.fingerprint), own(other)
            draws = {x[:2] for x in a | b}
            assert math.isclose(r[name], len(a & b) / len(draws) if draws else 1.0)
    assert got[5].fingerprint == brute_fingerprint("one two three four")


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_next_document(spark, size):
    ids = random.Random(1).sample(range(10_000), 97)
    df = spark.createDataFrame([(k, f"t{k}") for k in ids], "doc_id long, text string").repartition(5)
    order = sorted(ids)
    want = {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.doc_id: r.next_text for r in omh.with_next(df, "text", group_rows=size).collect()} == want


def test_next_document_edges(spark, docs):
    assert omh.with_next(docs.select("doc_id", "text"), "text", group_rows=2).count() == 7
    assert omh.with_next(docs.select("doc_id", "text").limit(0), "text").collect() == []
    clash = docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("folio_to", "folio_lent", "_to", "_g", "folio_inner")])
    got = omh.with_next(clash, "text", group_rows=2)
    assert set(clash.columns) <= set(got.columns) and {r.folio_to for r in got.collect()} == {7}


# ------------------------------------------------------------------ 8 URLs
def test_urls(spark):
    html = lambda href: f'<html><head><LINK rel="canonical" href="{href}"></head>'
    rows = [(1, "http://A.b.NET/x?q", None), (2, "http://www.example.net/en/1", ""), (3, "http://alias.org/z", html("http://bad.net/p")), (4, "http://other.org/z#f", html("http://alias.org/z")), (5, "http://mixed.com/a", html("http://bad.net/p2")), (6, "http://mixed.com/a", html("http://ok.org/fr/1")), (7, None, None), (8, "nothing", None), (9, "http://net", None), (10, "http://fine.org/de/", '<meta http-equiv="refresh" content="0;url=http://fine.org/x">')]
    p = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(list(urlfilter.RULES), "rule string, verdict string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urlfilter.judge_urls(p, rules).collect()}
    assert got == {1: ("a.b.net", "net/", "block"), 2: ("www.example.net", "example.net/en/", "allow"), 3: ("alias.org", None, "block"), 4: ("other.org", None, "block"), 5: ("mixed.com", None, "allow"), 6: ("mixed.com", None, "allow"), 7: ("", None, "allow"), 8: ("", None, "allow"), 9: ("net", None, "allow"), 10: ("fine.org", None, "allow")}
    many = rules.unionByName(spark.range(600).selectExpr("concat('h', id, '.example/') as rule", "'block' as verdict"))
    assert {r.page_id: (r.host, r.rule, r.verdict) for r in urlfilter.judge_urls(p, many).collect()} == got
    assert urlfilter.judge_urls(p.limit(0), rules.limit(0)).collect() == []


# ------------------------------------------------------------------ 9 language
def test_language(spark, docs, monkeypatch):
    d = langid.split_by_crc(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 4, 2)
    model = langid.train(d.where("not held_out"))
    got = langid.identify(d.where("held_out"), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("lang_rejected").cast("int"))).first()
    assert got[0] > 0.99 and got[1] < 0.01
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "Съешь же ещё этих мягких французских булок")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(rows[k].lang_rejected for k in (1, 2, 3, 4)) and rows[4].lang_pred != "und"
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    dirty = spark.createDataFrame([(k, f"word{k} text", f"x{k}" if k > 9 else "ab"[k % 2]) for k in range(40)], "doc_id long, text string, lang string")
    assert set(langid.train(dirty).langs) == {"a", "b"}
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


# ------------------------------------------------------------------ 10 HTML
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) "</p>";</script><style>p{}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>One <i>two</i>
 three<br>four<p>Five &lt;six&gt; &#233;&nbsp;x<p class="cookie-notice">Cookies<aside>Side</aside><form><input value=x>F</form><ul><li>a<li>b</ul><section id="comments"><p>Me first</section></article><footer>&copy; f</footer></body></html>"""


def test_main_text():
    assert htmlextract.main_text(PAGE) == "Title & more\nOne two three four\nFive <six> é x\na\nb"
    assert htmlextract.main_text(None) == htmlextract.main_text("") == htmlextract.main_text("<p>") == ""
    assert htmlextract.main_text("a < b <b>c</b>d") == "a < b cd"
    assert htmlextract.main_text("<div>x<p>y</p>z</div><!-- no --><script>n") == "x\ny\nz"
    assert htmlextract.main_text("<div>" * 3000 + "deep") == "deep"
    assert htmlextract.main_text("<p>" + "word " * 100_000).count("word") == 100_000


@pytest.mark.parametrize("name", ['section id="discussion"', 'div class="ad-hoc-analysis"', 'p class="share-price"', 'div class="related-work"', 'p class="notice-period"'])
def test_names_of_article_parts_stay(name):
    tag = name.split()[0]
    assert htmlextract.main_text(f"<article><p>A</p><{name}>B</{tag}><p>C</article>") == "A\nB\nC"


def site(rng, host, n, article):
    """Pages of a site whose menu, teasers and footer differ from page to page; (url, html, text of the story)."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    say = lambda k: " ".join(word() for _ in range(k))
    out = []
    for k in range(n):
        menu = "".join(f'<li><a href="/{word()}">{say(2)}</a></li>' for _ in range(rng.randrange(3, 9)))
        teasers = "".join(f'<div class="t{j}"><a href="/{word()}">{say(6)}</a> {word()}</div>' for j in range(rng.randrange(2, 5)))
        story = [say(4), *(say(rng.randrange(10, 60)) for _ in range(rng.randrange(1, 4)))]
        body = f"<h1>{story[0]}</h1>" + "".join(f'<p>{p[:9]}<a href="/x">{p[9:14]}</a>{p[14:]}</p>' for p in story[1:])
        body = f"<article>{body}</article>" if article else f'<div class="main{k}">{body}</div>'
        html = f'<body><div class="top"><ul>{menu}</ul></div><div>Our site since 1990</div>{body}<div class="more">{teasers}</div><div class="end"><b>All rights</b> kept</div></body>'
        out.append((f"http://{host}/{k}", html, "\n".join(story)))
    return out


def test_counting_finds_what_differs_from_page_to_page(spark):
    """The ablation: without templates menus, teasers and the footer stay; with them the story alone is left."""
    rng = random.Random(9)
    rows = [(k, *r) for k, r in enumerate(site(rng, "a.org", 12, False) + site(rng, "b.org", 12, True) + site(rng, "few.org", 3, False))]
    p = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = {r[0]: r[3] for r in rows}
    for names in (True, False):
        got = {r.page_id: r.text for r in htmlextract.extract_text(p, names=names).collect()}
        assert {k: got[k] for k in range(24)} == {k: want[k] for k in range(24)}
    off = {r.page_id: r.text for r in htmlextract.extract_text(p, min_pages=1000).collect()}
    assert all(off[k] != want[k] and want[k] in off[k] for k in range(12))
    assert all(off[k] == want[k] for k in range(12, 24))  # the article element alone says it
    assert all(want[k] in off[k] and off[k] == got[k] for k in range(24, 27))  # too few pages to count


def test_templates_against_brute_force(spark):
    rng = random.Random(10)
    rows = site(rng, "a.org", 9, False) + site(rng, "b.org", 7, True)
    rows += [rows[0]] * 9  # copies count once
    got = {r.host: set(r.hashes) for r in htmlextract.site_templates(spark.createDataFrame([r[:2] for r in rows], "url string, html string")).collect()}
    for host in ("a.org", "b.org"):
        pages_ = {}
        for url, html, _ in rows:
            if host in url:
                key, parts = htmlextract.page_profile(html)
                pages_[key] = parts
        seen: dict = {}
        for parts in pages_.values():
            for x in parts:
                seen.setdefault(x["h"], []).append((x["size"], x["links"]))
        often = {h for h, v in seen.items() if len(v) >= 5 and len(v) >= 0.3 * len(pages_) and (v[0][0] < 0 or sum(m for _, m in v) >= 0.6 * sum(n for n, _ in v))}
        assert often and got[host] == often


def test_templates_go(spark):
    page = lambda k: f"<body><div class=top><b>Our site</b> since 1990</div><div><p>Story {k} is told.</p></div><div><p>Rights of all</p></div></body>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(8)] + [(90, "http://i.org/", page(90)), (91, None, None), (92, None, "")]
    p = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmlextract.extract_text(p).collect()}
    assert got[3] == "Story 3 is told." and got[90] == "Our site since 1990\nStory 90 is told.\nRights of all" and got[91] == got[92] == ""
    assert htmlextract.extract_text(p.limit(0)).collect() == []


def test_digest_helpers():
    assert warc.digest32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
