"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of ``K`` tokens, each numbered by its occurrence.  Tokens are runs other than white space, cut
every 16 characters; ideographs, kana and their marks stand alone.  Each of ``DRAWS`` draws has a random order of its own over all
numbered k-mers; it keeps the ``KEEP`` smallest, puts them back in text order and hashes the tuple of them.  Two texts
agree in a draw if they keep the same k-mers in the same order, so moving text changes the fingerprint although no
k-mer set changes.

A draw's order is made in rounds: in each round a hash of the round deals every k-mer to one draw, and a draw takes
k-mers by the round that first deals them to it, then by that round's hash.  Whatever the text, that is a full order of
all k-mers for each draw, but only as many rounds are computed as are needed to give each draw about ``DEALT`` k-mers: one
for a text of DRAWS * DEALT tokens or more, DRAWS * DEALT k-mer hashes in all for any shorter one.

Inside, an entry is one long, so that sorting longs sorts by draw, round and hash: 6 bits of draw, 10 of round, then
hash, then the k-mer's place among the numbered ones in 24 bits, or as many more as a longer text needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

K, DRAWS_LOG2, KEEP = 3, 6, 2
DRAWS = 1 << DRAWS_LOG2
DEALT = 8
ROUND_BITS = 10  # enough for a text of one token: DRAWS * DEALT rounds
ROUND_AT = 64 - DRAWS_LOG2 - ROUND_BITS
AT = 24
CJK = r"\u2E80-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"  # ideographs, kana and their marks
TOKENS = rf"[^\s{CJK}]{{1,16}}|[{CJK}]"
GROUP_ROWS = 2000
MOST_GROUPS = 65_536


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _low(bits: Column) -> Column:
    """That many low bits, set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def _starts(s: Column, new: Callable[[Column], Column]) -> Column:
    """Places (from 0) in the sorted array ``s`` where a new group begins: new(place), asked from the second on."""
    places = F.sequence(F.lit(0), F.size(s) - 1)
    return F.filter(places, lambda j: (j == 0) | new(j))


def _runs(starts: Column, size: Column, body: Callable[[Column, Column], Column]) -> Column:
    """For each group: body(first place, last place)."""
    return F.transform(starts, lambda a, k: body(a, F.coalesce(F.get(starts, k + 1), size) - 1))


def _numbered(hashes: Column) -> Column:
    """struct of two arrays, aligned: hash of each k-mer with its occurrence number, and its position in the text.

    Sorting hashes that carry their position in their low bits groups equal k-mers in text order.  Texts of more than
    2^24 tokens leave fewer bits of hash to group by; the hashes returned are made of whole ones.
    """
    wide = F.greatest(F.lit(AT), F.length(F.bin(F.size(hashes).cast("long"))))

    def of(bits: Column) -> Column:
        low = _low(bits)
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

        def groups(s: Column) -> Column:
            starts = _starts(s, lambda j: F.call_function("shiftrightunsigned", F.get(s, j).bitwiseXOR(F.get(s, j - 1)), bits) != 0)
            at = lambda j: F.get(s, j).bitwiseAND(low).cast("int")
            each = lambda a, b: F.transform(F.sequence(a, b), lambda j: F.xxhash64(F.get(hashes, at(j)), j - a))
            return F.struct(F.flatten(let(starts, lambda st: _runs(st, F.size(s), each))).alias("h"), F.transform(s, lambda x: x.bitwiseAND(low).cast("int")).alias("p"))

        return let(packed, groups)

    return let(wide, of)


def _signature(h: Column, p: Column) -> Column:
    """array<struct<bin, value>> of the draws, from the numbered k-mers' hashes and positions."""
    n = F.size(h)
    rounds = F.greatest(F.lit(1), F.ceil(F.lit(DRAWS * DEALT) / n).cast("int"))
    wide = F.greatest(F.lit(AT), F.length(F.bin(n.cast("long"))))
    draw_of = lambda x: F.shiftrightunsigned(x, 64 - DRAWS_LOG2)

    def of(bits: Column) -> Column:
        low = _low(bits)
        # A hash's top bits are its draw; its next ones give way to the round, its last ones to the place.
        keep = F.bitwise_not(low.bitwiseOR(F.lit(((1 << ROUND_BITS) - 1) << ROUND_AT)))

        def entry(x: Column, r: Column, i: Column) -> Column:
            return F.xxhash64(x, r).bitwiseAND(keep).bitwiseOR(F.shiftleft(r.cast("long"), ROUND_AT)).bitwiseOR(i.cast("long"))

        one_round = lambda r: F.transform(h, lambda x, i: entry(x, r, i))
        entries = F.when(rounds == 1, one_round(F.lit(0))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), rounds - 1), one_round)))

        def one(s: Column) -> Callable[[Column, Column], Column]:
            def body(a: Column, b: Column) -> Column:
                # The first KEEP different k-mers: later rounds may deal one again, so all of a run are looked at where
                # there are several rounds.
                places = lambda upto: F.array_distinct(F.transform(F.sequence(a, upto), lambda j: F.get(s, j).bitwiseAND(low).cast("int")))
                chosen = F.slice(places(F.when(rounds == 1, F.least(b, a + KEEP - 1)).otherwise(b)), 1, KEEP)
                ordered = F.array_sort(F.transform(chosen, lambda i: F.struct(F.get(p, i).alias("p"), F.get(h, i).alias("h"))))
                value = F.xxhash64(F.transform(ordered, lambda x: x["h"]))
                return F.struct(draw_of(F.get(s, a)).cast("int").alias("bin"), value.bitwiseAND(F.lit(0xFFFFFFFF)).alias("value"))

            return body

        def drawn(s: Column) -> Column:
            starts = _starts(s, lambda j: draw_of(F.get(s, j).bitwiseXOR(F.get(s, j - 1))) != 0)
            return F.array_sort(let(starts, lambda st: _runs(st, F.size(s), one(s))))

        return let(F.sort_array(entries), drawn)

    return let(wide, of)


def fingerprint(text: Column, k: int = K) -> Column:
    """array<struct<bin, value>>: the draws in their order, each with its value.  Null text is empty and has none; equal
    texts have equal fingerprints; a text of fewer than k tokens has k-mers of what there is, and one k-mer stands alone
    in each draw."""

    def kmers(tokens: Column) -> Column:
        following = lambda i: [F.get(tokens, i + d) for d in range(1, k)]
        return F.transform(tokens, lambda w, i: F.xxhash64(w, *following(i)))

    none = F.expr("cast(array() as array<struct<bin: int, value: bigint>>)")
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))
    return let(tokens, lambda t: F.when(F.size(t) == 0, none).otherwise(let(let(kmers(t), _numbered), lambda x: _signature(x["h"], x["p"]))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws among the draws that either text has; 1 if neither has any."""
    equal = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(F.transform(a, lambda x: x["bin"]), F.transform(b, lambda x: x["bin"])))
    return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)


def as_text(f: Column) -> Column:
    """Two hex digits of draw and eight of value for each draw, joined by blanks."""
    return F.array_join(F.transform(f, lambda x: F.concat(F.lpad(F.lower(F.hex(x["bin"])), 2, "0"), F.lpad(F.lower(F.hex(x["value"])), 8, "0"))), " ")


def with_next(documents: DataFrame, *columns: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``documents`` with next_<column> of the following row in order of doc_id; the last is followed by the first.

    Rows are dealt to groups by doc_id bounds of about equal counts (at most ``MOST_GROUPS``, which is what the driver
    holds), and each group is lent the first row of the group after it, so no group's window needs another's rows
    and the texts move once.  A row finds its group by some hundred outer bounds and then by the bounds between
    two of those, which a small table brings along.  Null doc_ids come first; among equal doc_ids, rows go by the columns;
    rows equal in all of these follow each other.  A doc_id of very many rows is one group.  Other columns pass through.
    """
    spark = documents.sparkSession
    n = documents.count()
    groups = min(MOST_GROUPS, max(1, n // group_rows))
    probs = [k / groups for k in range(1, groups)]
    least = F.lit(-(1 << 63))
    row = documents.agg(F.min(F.coalesce("doc_id", least)).alias("low"), F.percentile_approx("doc_id", probs, 100 * groups).alias("bounds") if probs else F.lit(None).alias("bounds")).first()
    bounds = sorted(set(row.bounds or []) - {row.low})
    names: dict[str, str] = {}
    for stem in ("top", "inner", "own", "to", "lent"):
        names[stem] = fresh(documents, f"folio_{stem}")
    top, inner, own, to, lent = names.values()
    key = F.coalesce(F.col("doc_id"), least)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    outer = F.array(*[F.lit(b[0]).cast("long") for b in blocks]) if blocks else F.expr("cast(array() as array<bigint>)")
    table = spark.createDataFrame([(k + 1, b) for k, b in enumerate(blocks)], f"{top} int, {inner} array<long>")
    d = documents.withColumn(top, F.size(F.filter(outer, lambda b: b <= key))).join(F.broadcast(table), top, "left")  # at most MOST_GROUPS longs
    d = d.withColumn(own, F.when(F.col(top) == 0, F.lit(0)).otherwise((F.col(top) - 1) * step + F.size(F.filter(inner, lambda b: b <= key))))
    edge = F.coalesce(F.array_contains(inner, key), F.lit(False))
    to_groups = F.when(key == row.low, F.array(F.col(own), F.lit(len(bounds)))).when(edge, F.array(F.col(own), F.col(own) - 1)).otherwise(F.array(F.col(own)))
    # With one group, the first row is lent to its own group too.
    d = d.select("*", F.posexplode(to_groups).alias(lent, to))
    w = Window.partitionBy(to).orderBy(lent, F.col("doc_id").asc_nulls_first(), *columns)
    return d.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where(F.col(lent) == 0).drop(top, inner, own, to, lent)


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs.withColumn("f", fingerprint(F.col("text"))), "text", "f")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "f", "next_f", edited.alias("edited")).withColumn("e", fingerprint(F.col("edited")))
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"))
