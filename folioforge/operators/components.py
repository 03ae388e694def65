"""Connected components of a graph of any size."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..plans.shared import forget, save

# Rows of one part of a shuffle: what a task holds doesn't grow with the graph.
PART_ROWS = 500_000
# Tables of so many rows, two numbers each, are broadcast.
SMALL_ROWS = 100_000


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    In each round a node picks, of itself and its neighbours, the least in an order of that round, and edges move to the
    picks of their ends, until none is left; then the picks are followed.  Nodes are 64-bit numbers meanwhile.  Keys
    with many rows pass through joins unsorted, and each round's tables go to the shared folder.  Loops and nulls are
    ignored.
    """
    a, b = F.col("a"), F.col("b")
    kind = edges.select(F.greatest(a, b).alias("k")).schema["k"].dataType
    raw = save(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.cast(kind).alias("a"), b.cast(kind).alias("b")), name)
    n = raw.count()
    if not n:
        return raw.select(a.alias("node"), b.alias("component"))
    nodes = None
    if isinstance(kind, (ST.ByteType, ST.ShortType, ST.IntegerType, ST.LongType)):
        now = raw.select(a.cast("long").alias("a"), b.cast("long").alias("b"))
    else:
        nodes, seed = _numbered(raw, n, name)
        now = raw.select(_number(a, seed).alias("a"), _number(b, seed).alias("b"))

    saved, picks = raw, []
    for i in range(rounds):
        pick = _saved(_picked(now, n, i), 2 * n, name)
        picks.append((pick, pick.count()))
        moved = _replaced(_replaced(now, "a", *picks[-1], n), "b", *picks[-1], n).where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        now = _saved(moved.repartition(_parts(n), "a", "b").distinct(), n, name)
        forget(saved)
        saved, n = now, now.count()
        if not n:
            break
    else:
        raise RuntimeError("components did not settle")
    forget(saved)

    # From the last round back: where the pick of a node's pick leads.
    label, m = picks.pop()
    while picks:
        pick, m_pick = picks.pop()
        new = save(_replaced(pick, "r", label, m, m_pick, "left"), name)
        forget(label, pick)
        label, m = new, m_pick

    parts = _parts(m)
    if nodes is None:
        named = label.select(F.col("v").cast(kind).alias("node"), "v", "r")
    else:
        named = _joined(nodes, label, ["v"], m)
    named = save(named.select("node", "r", F.pmod(F.xxhash64("v"), F.lit(parts)).alias("s")), name)
    forget(label, *([nodes] if nodes is not None else []))
    # The smallest node of each part of a component, then of the component: a large one is in all parts.
    low = _saved(named.repartition(parts, "r", "s").groupBy("r", "s").agg(F.min("node").alias("low")), m, name)
    least = _saved(low.repartition(parts, "r").groupBy("r").agg(F.min("low").alias("component")), m, name)
    if least.count() <= SMALL_ROWS:
        forget(low)
        return named.join(F.broadcast(least), "r").select("node", "component")
    found = _joined(low, least, ["r"], m).select("r", "s", "component")
    return _joined(named, found, ["r", "s"], m).select("node", "component")


def _parts(rows: int) -> int:
    return rows // PART_ROWS + 1


def _saved(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df``, dealt out as ``rows`` rows, in the shared folder, in no more files than that, however many parts it was
    dealt to.

    A round writes two tables, and Hadoop's local file system starts three processes for each file; each of these is
    at first a copy of the executor that starts it."""
    return save(df.coalesce(_parts(rows)), name)


def _joined(x: DataFrame, t: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """``x`` joined with ``t``, whose keys are unique: only ``t`` is held in memory, in as many parts as ``rows`` ask for."""
    parts = _parts(rows)
    # Spark raises smaller numbers to the session's, which it adapts only if it chose it.
    if parts >= int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        x, t = x.repartition(parts, *keys), t.repartition(parts, *keys)
    return x.join(t.hint("shuffle_hash"), keys, how)


def _number(node: Column, seed: int) -> Column:
    return F.xxhash64(node, F.lit(seed))


def _numbered(raw: DataFrame, n: int, name: str) -> tuple[DataFrame, int]:
    """(v, node) of edges of any type, each node with a number of its own, and the seed of :func:`_number` that gives it."""
    for seed in itertools.count():
        x = raw.select(F.explode(F.array("a", "b")).alias("node")).select(_number(F.col("node"), seed).alias("v"), "node")
        nodes = _saved(x.repartition(_parts(2 * n), "v").distinct(), 2 * n, name)
        if not nodes.repartition(_parts(nodes.count()), "v").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
            return nodes, seed
        forget(nodes)


def _picked(edges: DataFrame, n: int, i: int) -> DataFrame:
    """(v, r): of each node of the edges and its neighbours, the least in the order of round ``i``.

    Two rounds share an order: in the second all neighbours of a hub pick what the hub picked in the first."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    x = edges.select(F.explode(ends).alias("e")).select("e.v", "e.w").repartition(_parts(2 * n), "v")
    order = F.xxhash64("w", F.lit(i // 2))
    best = x.groupBy("v").agg(F.min_by("w", order).alias("w"), F.min(order).alias("h"))
    return best.select("v", F.when(F.xxhash64("v", F.lit(i // 2)) < F.col("h"), F.col("v")).otherwise(F.col("w")).alias("r"))


def _replaced(x: DataFrame, c: str, table: DataFrame, m: int, n: int, how: str = "inner") -> DataFrame:
    """``x`` of ``n`` rows with column ``c`` looked up in ``table`` (v, r) of ``m`` rows; with ``left``, kept if not found."""
    t = table.select(F.col("v").alias(c), F.col("r").alias("_to"))
    if m <= SMALL_ROWS:
        j = x.join(F.broadcast(t), c, how)
    else:
        j = _joined(x, t, [c], max(n, m), how)
    return j.select(*[F.coalesce("_to", c).alias(c) if k == c else k for k in x.columns])
