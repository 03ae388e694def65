"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is a set of windows of consecutive words; a document contains a window if all of the window's
words stand in it in a row.  Full containment needs a single prefix token, so each window is looked up by its
rarest word alone, where rarity is the word's count over all documents.  A document position with that word is a
candidate if the window fits around it (positional bound) inside the document (length bound), and the words there
are then compared exactly.

The benchmark is the stated query set.  Its distinct windows are joined in blocks of bounded rows and bytes, and only
such a block is ever broadcast; which items a window belongs to is joined to the matches afterwards.  Documents stay where
they were read; what is shuffled is a row per document and per match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, save, union_all

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after lower-casing
WINDOW = 8
MIN_ITEMS = 2
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 64 << 20  # of a block's words; one larger window is a block by itself at most


def words_of(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item string, words array) of all windows; an item of fewer words than ``width`` is one window, one
    without words has none.  A null item_id counts as an item with an empty name."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    return w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(width)).alias("words")).distinct()


def _blocks(rows: int, size: int, block_windows: int) -> int:
    return max(1, -(-rows // block_windows), -(-size // BLOCK_BYTES))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_items: int = MIN_ITEMS, block_windows: int = BLOCK_WINDOWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, ``carry``, n_words, n_hit (words inside any occurrence of a window), n_items (items
    with an occurring window), items (their ids as strings, sorted), contaminated (n_items >= min_items).

    Null text has no words and no hits, a null doc_id is kept; an empty benchmark gives no hits, an empty table no rows;
    whole texts are gone through, whatever their length; rows repeated in all of doc_id, text and ``carry`` are each
    returned, with equal results.  Words are compared as they are, ties in rarity go to the smaller word, then to the
    earlier place.  Columns to carry may have any name but those of the result; others are ignored.
    """
    spark = documents.sparkSession
    packed = F.struct("doc_id", *carry) if carry else F.struct("doc_id")
    docs = documents.select(packed.alias("row"), F.col("text"))
    found_items = save(item_windows(benchmark, width), "windows")
    windows = found_items.groupBy("words").agg(F.count(F.lit(1)).alias("n_items"))
    windows = save(windows.select("words", F.sha2(F.concat_ws(" ", "words"), 256).alias("window")).withColumn("block", F.pmod(F.xxhash64("window"), F.lit(1 << 20))), "windows")
    # Words hold no blanks: equal digests of the joined words are equal windows.
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "words"))), F.lit(0)).alias("b")).first()
    parts = _blocks(size.n, size.b, block_windows)
    # Rarity: how often each word of the benchmark stands in all documents; words are looked up by hash.
    terms = save(windows.select(F.explode("words").alias("word")).distinct().withColumn("h", F.xxhash64("word")), "terms")
    n_terms = max(1, -(-terms.count() // (8 * block_windows)))
    counted = []
    for k in range(n_terms):
        some = terms.where(F.pmod("h", F.lit(n_terms)) == k).select("h").distinct()
        at = docs.select(F.explode_outer(words_of(F.col("text"))).alias("x")).select(F.xxhash64("x").alias("h"))
        counted.append(at.join(F.broadcast(some), "h").groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    rarity = save(union_all(counted), "rarity")
    # The prefix token of each window, and with each prefix token its windows.
    placed = windows.select("window", "words", "block", F.posexplode("words").alias("j", "word")).join(terms.join(rarity, "h").select("word", "n"), "word", "left")
    prefix = placed.groupBy("window", "words", "block").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("j"))).alias("p"))
    table = save(prefix.groupBy(F.xxhash64("p.word").alias("h"), "block").agg(F.collect_list(F.struct(F.col("p.j").alias("j"), "words", "window")).alias("windows")), "prefixes")

    found = []
    for k in range(parts):
        some = table.where(F.pmod(F.col("block"), F.lit(parts)) == k).groupBy("h").agg(F.flatten(F.collect_list("windows")).alias("windows"))
        if k == 0:  # '' is no word: it stands once in front of each document's words and brings the document through
            some = some.unionByName(spark.createDataFrame([("", [])], f"x string, windows {table.schema['windows'].dataType.simpleString()}").select(F.xxhash64("x").alias("h"), "windows"))
        d = docs.select("row", F.xxhash64("text").alias("key"), F.concat(F.array(F.lit("")), words_of(F.col("text"))).alias("w"))
        at = d.select("row", "key", "w", F.posexplode_outer("w").alias("i", "x")).withColumn("h", F.xxhash64("x"))
        at = at.join(F.broadcast(some), "h")  # at most BLOCK_BYTES of words, or a single larger window
        # Higher-order functions stay out of the join, which is compiled and copies only candidates; the outer
        # explode keeps the optimizer from splitting each text twice to ask whether it has words.
        fits = F.filter("windows", lambda v: (F.col("i") - v["j"] >= 1) & (F.col("i") - v["j"] + F.size(v["words"]) <= F.size("w")) & (F.slice("w", F.greatest(F.col("i") - v["j"] + 1, F.lit(1)), F.size(v["words"])) == v["words"]))
        hits = F.transform(fits, lambda v: F.struct((F.col("i") - v["j"]).alias("a"), (F.col("i") - v["j"] + F.size(v["words"])).alias("b"), v["window"].alias("window")))
        found.append(at.select("row", "key", (F.col("i") == 0).cast("long").alias("is_row"), (F.size("w") - 1).cast("long").alias("n_words"), hits.alias("hits")))

    found = union_all(found)
    rows = found.groupBy("row", "key", "n_words").agg(F.sum("is_row").alias("rows"), F.flatten(F.collect_set(F.when(F.size("hits") > 0, F.col("hits")))).alias("hits"))
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["a"], h["b"]))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(spans, start, lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"])
    rows = save(rows.select("row", "key", "n_words", "rows", covered.alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("windows")), "hits")
    of_window = found_items.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("window"), "item")
    key = ["row", "key", "n_words", "rows", "n_hit"]
    hit = rows.where(F.size("windows") > 0).select(*key, F.explode("windows").alias("window")).join(of_window, "window").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    clean = rows.where(F.size("windows") == 0).select(*key, F.expr("cast(array() as array<string>)").alias("items"))
    out = hit.unionByName(clean).select("row", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    n = F.size("items").cast("long")
    return out.select("row.*", "n_words", "n_hit", n.alias("n_items"), "items", (n >= min_items).alias("contaminated"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = contamination(read("documents"), read("benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
     bs AS (SELECT item_id, w, least(len(w), 8) AS k, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM b WHERE len(w) > 0),
     v AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM bs),
     ks AS (SELECT DISTINCT k FROM v),
     ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
     g AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM ds),
     h AS (SELECT doc_id, s, g.k, item_id FROM g JOIN v ON g.g = v.g AND g.k = v.k),
     p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM h) GROUP BY doc_id),
     i AS (SELECT doc_id, count(DISTINCT item_id) AS n, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       coalesce(i.sha, sha256('')) AS items_sha256, coalesce(i.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
