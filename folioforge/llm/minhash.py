"""Near-duplicate groups by MinHash with tensored banding.

Table keys are pairs (i, j) of one of ``LEFT`` small bands of 3 minima and one of ``RIGHT`` small bands of 2, so
12 x 8 = 96 tables of 5 minima each cost 12*3 + 8*2 = 52 minima a document instead of 480.  A pair of Jaccard
similarity 0.8 shares no table with probability 5e-4, one of 0.9 with 2e-6.

Exact copies (equal shingle sets) are first folded into one representative.  In each table, representatives are
paired only with the smallest of their bucket (its hub), never with each other; links are confirmed on full
shingle sets and joined into components.  Where a bucket is then still split between components, its members are
searched exhaustively by a prefix filter: if two sets have similarity >= t, they share one of their
n - ceil(t*n) + 1 rarest shingles.  So every pair that shares a bucket is either joined or compared, whatever the
size of the bucket.  The filter also bounds where in its order a set may meet a partner of a given size (see
``_prefix_pairs``), so that pages which share a template but stay below the threshold don't meet there at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, connected_components, mix, save, small_batches, spread, text_blocks

LEFT, LEFT_ROWS, RIGHT, RIGHT_ROWS = 12, 3, 8, 2
BROADCAST_IDS = 1_000_000  # 8 bytes each
KEYED_ROWS = 10_000  # representatives whose keys one task makes
PAIRS_A_TASK = 128  # of one representative, when pairs meet its set
PAIRS_A_SHARE = 1_000_000  # of one shingle and size class, when sets look for partners
CLASS = 1.05  # between size classes

_seeds = mix(np.arange(1, 2 * (LEFT * LEFT_ROWS + RIGHT * RIGHT_ROWS) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
FACTORS = (_seeds[0::2] | np.uint64(1))[:, None]
TERMS = _seeds[1::2][:, None]
BASE = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes: of ``width`` words (runs of other than white
    space, A-Z lower-cased), or of all its words if they are fewer; empty without words."""
    for _, _, data, offsets in text_blocks(column):
        words = Words(data, offsets)
        n = len(words.hash)
        rolled = words.hash.copy()
        for k in range(1, width):
            rolled[: n - k] = rolled[: n - k] * BASE + words.hash[k:] if n > k else rolled[: n - k]
        # rolled[i] now holds word i .. i+width-1 for every i that has so many words after it
        rolled = mix(rolled)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in words.hash[a:b]:
                        h = h * BASE + x
                yield mix(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, a : a + 4096] * FACTORS + TERMS).min(axis=1))
    return low


def bands(shingles: np.ndarray) -> np.ndarray:
    """The LEFT and then the RIGHT small bands' hashes."""
    low = minima(shingles)
    left = low[: LEFT * LEFT_ROWS].reshape(LEFT, LEFT_ROWS)
    right = low[LEFT * LEFT_ROWS :].reshape(RIGHT, RIGHT_ROWS)
    out = np.empty(LEFT + RIGHT, np.uint64)
    for part, at in ((left, slice(0, LEFT)), (right, slice(LEFT, None))):
        h = part[:, 0]
        for k in range(1, part.shape[1]):
            h = mix(h * BASE + part[:, k])
        out[at] = h
    return out


def _kind(documents: DataFrame) -> str:
    return documents.schema["doc_id"].dataType.simpleString()


def _sketches(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the set, null if empty), bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, found = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(bands(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands"])

    return small_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(documents)}, n_shingles long, set_id binary, bands array<long>")


def _full_sets(documents: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(batch.column(1), width)], pa.list_(pa.int64()))], ["id", "s"])

    return small_batches(documents).mapInArrow(run, f"id {documents.schema['id'].dataType.simpleString()}, s array<long>")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, id): a row for each of the tables of each representative."""
    left, right = F.slice("bands", 1, LEFT), F.slice("bands", LEFT + 1, RIGHT)
    keys = F.flatten(F.transform(left, lambda a, i: F.transform(right, lambda b, j: F.xxhash64(a, b, i * RIGHT + j))))
    return reps.select("id", F.explode_outer(keys).alias("key"))


def _similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``documents`` (doc_id of any ordered type, text): doc_id, n_shingles, component_id (smallest doc_id reachable over
    links of Jaccard similarity >= ``percent`` / 100 between distinct shingle sets), kept (doc_id is the
    component's).

    Null, empty and blank texts have an empty set and link with nothing; shorter texts are one shingle; whole texts count,
    whatever their length.  Rows with the same doc_id count as one document: they share a component, and each is
    returned.  A row without doc_id is linked with nothing: its component is null and it is kept.  An empty table gives
    no rows.  Other columns, whatever their names, are ignored.
    """
    spark = documents.sparkSession
    sketch = save(_sketches(documents, width), "sketches")
    reps = sketch.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    reps = save(reps, "representatives")

    keys = _keys(reps.repartition(max(spread(spark), -(-reps.count() // KEYED_ROWS)), "id"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = save(keys.join(hubs, "key"), "buckets")  # key, id, hub of buckets of several
    stars = save(members.where("id <> hub").groupBy("id", "hub").agg(F.lit(1).alias("one")).select("id", "hub"), "stars")

    # Whole texts of the representatives that are in any bucket with others.
    wanted = save(members.select("id").distinct(), "wanted")
    n_wanted = wanted.count()
    side = F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted
    chosen = documents.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text").join(side, "id", "left_semi")
    sets = save(_full_sets(chosen, width), "sets") if n_wanted else spark.createDataFrame([], f"id {_kind(documents)}, s array<long>")
    # A doc_id with several texts has several sets: all are compared.

    # First each representative against its smallest hub, then whatever is still apart.
    first = stars.groupBy("id").agg(F.min("hub").alias("hub"))
    links = save(_confirm(first, sets, percent).unionByName(_same_id(sketch)), "links")
    part = connected_components(links)
    rest = _apart(stars.join(first, ["id", "hub"], "left_anti"), part)
    more = save(_confirm(rest, sets, percent), "links")
    if more.head(1):
        links = links.unionByName(more)
        part = connected_components(links)
    # Buckets that are still split: their members by prefix filter, exactly.
    named = members.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    split = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    left = save(named.join(split, "key", "left_semi").groupBy("id").agg(F.min("c").alias("c")), "unsettled")
    if left.head(1):
        pairs = _prefix_pairs(sets.join(left, "id"), percent)
        more = save(_confirm(pairs, sets, percent), "links")
        if more.head(1):
            links = links.unionByName(more)
            part = connected_components(links)

    # Components of representatives, then of their copies.
    of_set = reps.select("set_id", "id").join(part.withColumnRenamed("node", "id"), "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(sketch: DataFrame) -> DataFrame:
    """Links between the representatives of a doc_id that has several texts."""
    some = sketch.where("set_id is not null and doc_id is not null")
    several = some.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("doc_id")
    low = some.groupBy("set_id").agg(F.min("doc_id").alias("b"))
    return some.join(several, "doc_id", "left_semi").join(low, "set_id").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame, key: str, name: str, counted: DataFrame) -> DataFrame:
    """``pairs`` (id, hub, ...), counted by the plain (id, hub) of ``counted``, with the full set of ``key`` as ``name``.

    A key of many pairs is dealt to several tasks, and a copy of its set to each: one for PAIRS_A_TASK pairs.  There
    are fewer such keys than pairs / PAIRS_A_TASK; they are broadcast if they are few, else joined."""
    many = save(counted.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("_shares")).where("_shares > 1"), "shared-keys")
    if many.count() <= BROADCAST_IDS:
        many = F.broadcast(many)
    shares = F.coalesce("_shares", F.lit(1))
    other = "hub" if key == "id" else "id"
    dealt = pairs.join(many, key, "left").withColumn("_share", F.pmod(F.xxhash64(other), shares).cast("int")).drop("_shares")
    copies = sets.select(F.col("id").alias(key), F.col("s").alias(name)).join(many, key, "left")
    copies = copies.select(key, name, F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share"))
    return dealt.join(copies, [key, "_share"]).drop("_share")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (id, hub) whose full sets are as similar as asked."""
    pairs = save(pairs, "pairs")
    both = _with_sets(_with_sets(pairs, sets, "id", "s1", pairs), sets, "hub", "s2", pairs)
    near = both.where((F.size("s1") * 100 >= F.size("s2") * percent) & (F.size("s2") * 100 >= F.size("s1") * percent))
    return near.where(_similar(F.col("s1"), F.col("s2"), percent)).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Those of the pairs (id, hub) that aren't in one component."""
    x = part.select(F.col("node").alias("id"), F.col("component").alias("c1"))
    y = part.select(F.col("node").alias("hub"), F.col("component").alias("c2"))
    return pairs.join(x, "id", "left").join(y, "hub", "left").where(F.coalesce("c1", "id") != F.coalesce("c2", "hub")).select("id", "hub")


def _shared(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of two sets of sizes a and b that are as similar as asked."""
    return F.floor(((a + b) * percent + 99 + percent) / (100 + percent))


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(id, hub) of sets (id, s, c) with different c that may be similar.

    Shingles are ordered by rarity.  If sets of sizes a >= b are similar, they share ``_shared(a, b)`` shingles, and the
    first that they share has at least as many from it on, in either order.  So the smaller set is listed under the
    shingles that leave enough for a partner of its own size, which is about half of what a partner of any size
    would need, and the larger one looks its shingles up under size classes (``CLASS`` apart), in each of them only those
    that leave enough for it.  Sets that share most of their shingles but too few thus never meet under a common one.

    A shingle of one component only is left out; the lookups of one that still makes many pairs are dealt to several tasks.
    """
    sets = save(sets, "unsettled-sets")
    often = sets.select("c", F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("x", "n")
    ranked = sets.select("id", "c", F.size("s").alias("size"), F.explode("s").alias("x")).join(often, "x", "left")
    # Shingles without a partner in another component come first: they are as rare as any.
    rare_first = ranked.groupBy("id", "c", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("x")))).alias("o"))
    least = F.floor((F.col("size") * percent + 99) / 100).cast("int")
    tokens = rare_first.withColumn("o", F.slice("o", F.lit(1), F.col("size") - least + 1))
    tokens = tokens.select("id", "c", "size", F.posexplode("o").alias("at", "e")).where("e.n > 1").select("id", "c", "size", (F.col("size") - F.col("at")).alias("rest"), F.col("e.x").alias("x"))
    class_of = lambda n: F.floor(F.log(n) / float(np.log(CLASS))).cast("int")
    smallest = lambda k: F.greatest(least, (F.floor(F.pow(F.lit(CLASS), k)) - 1).cast("int"))
    classes = F.filter(F.sequence(class_of(least), class_of(F.col("size"))), lambda k: F.col("rest") >= _shared(F.col("size"), smallest(k), percent))
    listed = F.when(F.col("rest") >= _shared(F.col("size"), F.col("size"), percent), F.array(F.struct(F.lit(True).alias("listed"), class_of(F.col("size")).alias("k")))).otherwise(F.expr("cast(array() as array<struct<listed: boolean, k: int>>)"))
    rows = tokens.select("*", F.explode(F.concat(F.transform(classes, lambda k: F.struct(F.lit(False).alias("listed"), k.alias("k"))), listed)).alias("r")).select("id", "c", "size", "rest", "x", "r.listed", "r.k")
    rows = save(rows, "prefix-tokens")
    count = F.count_if
    keys = rows.groupBy("x", "k").agg(count("listed").alias("n_listed"), count(~F.col("listed")).alias("n_looked"), F.min("c").alias("low"), F.max("c").alias("high")).where("n_listed > 0 and n_looked > 0 and low < high")
    keys = keys.select("x", "k", F.least("n_looked", F.ceil(F.col("n_looked") * F.col("n_listed") / PAIRS_A_SHARE)).cast("int").alias("shares"))
    met = rows.join(keys, ["x", "k"])
    a = met.where(~F.col("listed")).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).alias("a")
    b = met.where("listed").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("x", "k", "share")])
    on = on & (F.col("a.c") != F.col("b.c")) & ((F.col("a.size") > F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.id") > F.col("b.id"))))
    on = on & (F.col("b.size") * 100 >= F.col("a.size") * percent) & (F.least("a.rest", "b.rest") >= _shared(F.col("a.size"), F.col("b.size"), percent))
    return a.join(b, on).select(F.greatest("a.id", "b.id").alias("id"), F.least("a.id", "b.id").alias("hub")).distinct()


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
     f AS (SELECT g, count(*) AS f FROM g GROUP BY g),
     r AS (SELECT g.doc_id, g.g, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY f.f, g.g) AS k FROM g JOIN n USING (doc_id) JOIN f USING (g)),
     pre AS (SELECT doc_id, g, n FROM r WHERE k <= n - ((n * 4 + 4) // 5) + 1),
     c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
     i AS (SELECT c.x, c.y, count(*) AS i FROM c JOIN g a ON a.doc_id = c.x JOIN g b ON b.doc_id = c.y AND a.g = b.g GROUP BY c.x, c.y),
     l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
     e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
     reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node WHERE reach.root < e.y),
     m AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, w.doc_id = m.root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.node = w.doc_id
"""
