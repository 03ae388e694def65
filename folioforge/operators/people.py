"""Author entity resolution: vocabulary and typo correction, blocking, precision-first clusters, initials, overrides,
ids that stay over rebuilds."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..plans.shared import save
from .components import connected_components

PARTS = "name string, given array<string>, surname array<string>, keys array<string>, garbage boolean"


def name_parts(names: DataFrame) -> DataFrame:
    """(name, given, surname, keys, garbage) of distinct names."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            split = [N.given_surname(N.name_tokens(x)) for x in b["name"]]
            yield pd.DataFrame({"name": b["name"], "given": [list(g) for g, _ in split], "surname": [list(s) for _, s in split], "keys": [N.block_keys(x) for x in b["name"]], "garbage": [N.is_garbage(x) for x in b["name"]]})

    return names.where("name is not null").select("name").distinct().mapInPandas(run, PARTS)


def vocabulary(parts: DataFrame) -> DataFrame:
    """(token, role, n) of given words and surname words of two letters or more."""
    words = F.filter(F.flatten(F.transform("surname", lambda u: F.split(u, "-"))), lambda w: ~w.isin(*N.PARTICLES, "y"))
    both = F.concat(F.transform("given", lambda w: F.struct(w.alias("token"), F.lit("given").alias("role"))), F.transform(words, lambda w: F.struct(w.alias("token"), F.lit("surname").alias("role"))))
    return parts.where("not garbage").select(F.explode(both).alias("x")).select("x.*").where(F.length("token") > 1).groupBy("token", "role").agg(F.count(F.lit(1)).alias("n"))


def deletions(c):
    """A word and the words one deletion away: two words within one edit or swap share one of these."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))


def within_one(a, b):
    """Whether restricted Damerau-Levenshtein distance is at most one, without a UDF: a plain edit, or equal but for two
    neighbouring characters swapped."""
    n = F.length(a)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i, j = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    one = F.lit(1)
    swap = (n == F.length(b)) & (F.size(at) == 2) & (j == i + 1) & (F.substring(a, i, one) == F.substring(b, j, one)) & (F.substring(a, j, one) == F.substring(b, i, one))
    return (F.levenshtein(a, b) <= 1) | swap


def neighbours(words: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(role, token, other): words of one role within distance one.  Exact, by shared deletion variants."""
    x = (probes if probes is not None else words).select("role", "token", F.explode(deletions(F.col("token"))).alias("v"))
    y = words.select("role", F.col("token").alias("other"), F.explode(deletions(F.col("token"))).alias("v"))
    pairs = x.join(y, ["role", "v"]).where("token <> other").select("role", "token", "other").distinct()
    return pairs.where(within_one(F.col("token"), F.col("other")))


def corrections(vocab: DataFrame, ratio: float = 2.0, max_own: int = 1) -> DataFrame:
    """(token, role, corrected): words seen at most ``max_own`` times, next to one ``ratio`` times as frequent; the most
    frequent wins, then the smaller."""
    rare = vocab.where(F.col("n") <= max_own)
    near = neighbours(vocab, rare).join(vocab.select("role", F.col("token").alias("other"), F.col("n").alias("m")), ["role", "other"]).join(rare, ["role", "token"])
    return near.where(F.col("m") >= ratio * F.greatest("n", F.lit(1))).groupBy("token", "role").agg(F.min(F.struct(-F.col("m"), F.col("other").alias("other")))["other"].alias("corrected"))


def correct_parts(parts: DataFrame, fixes: DataFrame) -> DataFrame:
    """``parts`` with each given and surname word corrected, connectors kept; keys made anew."""
    words = parts.select("name", F.explode(F.concat(F.transform("given", lambda w, i: F.struct(F.lit("given").alias("role"), i.alias("i"), F.lit(0).alias("j"), w.alias("token"))), F.flatten(F.transform("surname", lambda u, i: F.transform(F.split(u, "-"), lambda w, j: F.struct(F.lit("surname").alias("role"), i.alias("i"), j.alias("j"), w.alias("token"))))))).alias("x")).select("name", "x.*")
    fixed = words.join(fixes, ["token", "role"], "left").withColumn("w", F.coalesce("corrected", "token"))
    units = fixed.groupBy("name", "role", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda x: x["w"]).alias("ws"))
    lists = units.groupBy("name").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("i", "ws")))), lambda x: F.array_join(x["ws"], "-")).alias(r) for r in ("given", "surname")])
    flat = F.filter(F.flatten(F.transform("surname", lambda u: F.split(u, "-"))), lambda w: ~w.isin(*N.PARTICLES, "y"))
    keys = F.when(F.size(flat) > 0, F.array_distinct(F.array(F.element_at(flat, 1), F.element_at(flat, -1)))).otherwise(F.expr("cast(array() as array<string>)"))
    return parts.select("name", "garbage").join(lists, "name", "left").select("name", *[F.coalesce(r, F.expr("cast(array() as array<string>)")).alias(r) for r in ("given", "surname")], "garbage").withColumn("keys", keys).select("name", "given", "surname", "keys", "garbage")


def signatures(parts: DataFrame) -> DataFrame:
    """Names of equal parts under their smallest name, so that only representatives are compared."""
    return parts.where("not garbage").groupBy("given", "surname").agg(F.min("name").alias("rep"), F.first("keys").alias("keys"), F.collect_list("name").alias("members"))


def given_keys(given):
    """What two lists of given words share if they match by 0.9 on average: then some pair of words scores that much, so it
    is equal, or within one edit at nine letters or more, or both have 18 letters.  No given words have a key of their own."""
    of_word = lambda w: F.when(F.length(w) >= 9, deletions(w)).otherwise(F.array(w))
    long = F.when(F.exists(given, lambda w: F.length(w) >= 18), F.array(F.lit("*"))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(F.size(given) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(F.flatten(F.transform(given, of_word)), long)))


def compared(reps: DataFrame, test: str) -> DataFrame:
    """(a, b) of representatives that share a surname key, and for ``same_person`` a key of their given words, and pass a
    predicate of :mod:`folioforge.functions.names`, which runs in batches on what is left.

    So a bucket of a common surname is never paired whole.  Pairs are found by names alone; parts are joined afterwards.
    """
    x = reps.select(F.col("rep").alias("name"), F.explode("keys").alias("key"), *([given_keys(F.col("given")).alias("g")] if test == "same_person" else [F.array(F.lit("")).alias("g")]))
    x = x.select("name", "key", F.explode("g").alias("g"))
    a, b = x.alias("a"), x.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name")).distinct()
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(f"{side}_name"), F.col("given").alias(f"{side}_given"), F.col("surname").alias(f"{side}_surname")), f"{side}_name")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        check = getattr(N, test)
        for d in batches:
            ok = [check((tuple(p), tuple(q)), (tuple(r), tuple(s))) for p, q, r, s in zip(d["a_given"], d["a_surname"], d["b_given"], d["b_surname"], strict=True)]
            yield d.loc[ok, ["a_name", "b_name"]].rename(columns={"a_name": "a", "b_name": "b"})

    return pairs.mapInPandas(run, "a string, b string")


def greedy_split(members: DataFrame) -> DataFrame:
    """Components (component, name, given, surname) that hold a contradiction are split: names in order join the first
    part that all its members are compatible with."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((n, (tuple(g), tuple(s))) for n, g, s in zip(d["name"], d["given"], d["surname"], strict=True)), key=lambda r: r[0].encode())
        parts: list[list] = []
        if any(N.contradicts(x[1], y[1]) for i, x in enumerate(rows) for y in rows[:i]):
            for r in rows:
                for p in parts:
                    if all(N.same_person(r[1], o[1]) and not N.contradicts(r[1], o[1]) for o in p):
                        p.append(r)
                        break
                else:
                    parts.append([r])
        else:
            parts = [rows]
        return pd.DataFrame([(n, p[0][0]) for p in parts for n, _ in p], columns=["name", "grp"])

    return members.groupBy("component").applyInPandas(run, "name string, grp string")


def precision_clusters(names: DataFrame, correct: bool = True) -> DataFrame:
    """(name, grp): grp is the smallest name of the cluster; garbage names stand alone."""
    parts = name_parts(names)
    if correct:
        parts = correct_parts(parts, corrections(vocabulary(parts)))
    sig = signatures(parts)
    part = connected_components(compared(sig, "same_person"), "people").withColumnRenamed("node", "rep")
    named = sig.join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    many = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = greedy_split(named.join(many, "component", "left_semi").select("component", F.col("rep").alias("name"), "given", "surname"))
    grp = sig.join(split.withColumnRenamed("name", "rep"), "rep", "left").select(F.explode("members").alias("name"), F.coalesce("grp", "rep").alias("grp"))
    alone = parts.where("garbage").select("name", F.col("name").alias("grp"))
    out = grp.unionByName(alone)
    return out.join(out.groupBy("grp").agg(F.min("name").alias("low")), "grp").select("name", F.col("low").alias("grp"))


def _judged(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, compatible, weak) of pairs of groups, over all their names (``members``: grp, given, surname, hyphen):
    compatible if all may be initials of each other and some agree in the first surname; weak if all are."""
    side = lambda g: members.select(F.col("grp").alias(g), *[F.col(c).alias(f"{g}_{c}") for c in ("given", "surname", "hyphen")])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            name = lambda g: [(tuple(x), tuple(y), z) for x, y, z in zip(d[f"{g}_given"], d[f"{g}_surname"], d[f"{g}_hyphen"], strict=True)]  # noqa: E731, B023
            both = list(zip(name("a"), name("b"), strict=True))
            yield pd.DataFrame({"a": d["a"], "b": d["b"], "edge": [N.may_be_initials(x[:2], y[:2]) for x, y in both], "first": [N.first_surname_agrees(x, y) for x, y in both], "weak": [N.weak(x, y) for x, y in both]})

    found = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a string, b string, edge boolean, first boolean, weak boolean")
    return found.groupBy("a", "b").agg((F.bool_and("edge") & F.bool_or("first")).alias("compatible"), F.bool_and("weak").alias("weak"))


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def impute_initials(groups: DataFrame, coauthors: DataFrame | None = None) -> DataFrame:
    """Proposals (a, b) of groups to join: a bare initial on one side and all names compatible.

    An edge that is weak (every pair leaves out a first given name) or risky (a neighbour of one end is incompatible
    with the other) stays only where a coauthor group (``coauthors``: grp, co) is shared.  Components that still
    hold an incompatible pair lose their weak edges, then their risky ones; what is no clique then is left out.
    Neighbours are those before any risky edge goes.
    """
    parts = name_parts(groups.select("name")).join(groups, "name")
    members = save(parts.select("grp", "given", "surname", F.col("name").contains("-").alias("hyphen"), "keys", "garbage").distinct(), "members")
    initial = members.where(F.exists("given", lambda g: F.length(g) == 1)).select("grp").distinct()
    keyed = members.where("not garbage").select("grp", F.explode("keys").alias("key")).distinct()
    x = keyed.join(initial, "grp", "left_semi").withColumnRenamed("grp", "x")
    near = x.join(keyed.withColumnRenamed("grp", "y"), "key").where("x <> y").select(*_ordered("x", "y")).distinct()
    edges = save(_judged(near, members).where("compatible").select("a", "b", "weak"), "edges")
    if coauthors is None:
        shared = edges.select("a", "b").limit(0)
    else:
        co = coauthors.where("grp <> co").distinct()
        shared = edges.select("a", "b").join(co.withColumnRenamed("grp", "a"), "a").join(co.withColumnRenamed("grp", "b"), ["b", "co"]).select("a", "b").distinct()
    edges = save(edges.join(shared.withColumn("shared", F.lit(True)), ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(False))).where("shared or not weak"), "edges")

    both = edges.select(F.col("a").alias("mid"), F.col("b").alias("end")).unionByName(edges.select(F.col("b").alias("mid"), F.col("a").alias("end")))
    forks = both.withColumnRenamed("end", "p").join(both.withColumnRenamed("end", "q"), "mid").where("p < q")
    open_ = forks.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct().join(edges, ["a", "b"], "left_anti")
    apart = _judged(open_, members).where("not compatible").select(F.col("a").alias("p"), F.col("b").alias("q"))
    risky = forks.join(apart, ["p", "q"]).select(F.explode(F.array("p", "q")).alias("end"), "mid").select(*_ordered("mid", "end")).distinct()
    edges = edges.join(risky.withColumn("risky", F.lit(True)), ["a", "b"], "left").withColumn("risky", F.coalesce("risky", F.lit(False)))
    edges = save(edges.where("shared or not risky").select("a", "b", "weak", "risky"), "edges")

    def placed(part: DataFrame) -> DataFrame:
        """Components that hold a pair of ``never``."""
        p = part.select(F.col("node").alias("a"), "component")
        return never.join(p, "a").join(p.withColumnRenamed("a", "b"), ["b", "component"]).select("component").distinct()

    part = connected_components(edges.select("a", "b"), "initials")
    p = part.select("component", F.col("node").alias("a"))
    inside = p.join(p.withColumnRenamed("a", "b"), "component").where("a < b").select("a", "b").join(edges, ["a", "b"], "left_anti")
    never = save(_judged(inside, members).where("not compatible").select("a", "b"), "incompatible")
    for kind in ("weak", "risky", None):
        in_broken = part.join(placed(part), "component", "left_semi").select(F.col("node").alias("a")).distinct()
        marked = edges.join(in_broken.withColumn("broken", F.lit(True)), "a", "left")
        edges = save(marked.where(F.col("broken").isNull() | (~F.col(kind) if kind else F.lit(False))).drop("broken"), "edges")
        if kind:
            part = connected_components(edges.select("a", "b"), "initials")
    return edges.select("a", "b")


def apply_overrides(clusters: DataFrame, merge: DataFrame, split: DataFrame, impute: DataFrame | None = None) -> DataFrame:
    """Components of cluster, merge (a, b) and impute edges without split pairs; unknown names are left out."""
    edges = clusters.where("name <> grp").select(F.col("grp").alias("a"), F.col("name").alias("b"))
    for more in [merge, *([impute] if impute is not None else [])]:
        edges = edges.unionByName(more.select("a", "b"))
    known = clusters.select(F.col("name").alias("k"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(known.withColumnRenamed("k", "a"), "a", "left_semi").join(known.withColumnRenamed("k", "b"), "b", "left_semi")
    edges = edges.join(split.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti").distinct()
    part = connected_components(edges.select("a", "b"), "groups").withColumnRenamed("node", "name")
    return clusters.select("name").join(part, "name", "left").select("name", F.coalesce("component", "name").alias("grp"))


def raw_ids(authors: DataFrame) -> DataFrame:
    """(name, raw_id): last word of the name and four digits; repeats of one id, in order of name, get _00 to _99."""
    last = F.element_at(F.filter(F.split(T.fold(F.lower(T.name_swap(F.col("name")))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), -1)
    base = F.concat_ws("_", F.coalesce(last, F.lit("misc")), T.short_hash(F.col("name")))
    x = authors.select("name").distinct().withColumn("base", base)
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("name")))
    x = x.withColumn("raw_id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.lpad((F.col("k") - 2).cast("string"), 2, "0"))))
    return x.select("name", F.when(F.col("k") <= 101, F.col("raw_id")).otherwise(F.raise_error(F.lit("suffixes are used up"))).alias("raw_id"))


def choose_leaders(members: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(grp, leader): without a previous leader among the members (grp, name, doc_count) the largest member; else that of
    the largest previous group (``previous``: name, size), then the one with most documents, then the smallest name."""
    m = members
    m = m.join(previous, "name", "left") if previous is not None else m.withColumn("size", F.lit(None).cast("long"))
    w = Window.partitionBy("grp").orderBy(F.col("size").desc_nulls_last(), F.col("doc_count").desc(), "name")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").select("grp", F.col("name").alias("leader"))


def lost_letters(words: DataFrame) -> DataFrame:
    """(word, repaired): each word with ``?`` and the most frequent whole word of its length that agrees elsewhere, ties to
    the smaller; null where nothing explains it."""
    w = words.select(F.lower("word").alias("w"))
    whole = w.where(~F.col("w").contains("?")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    broken = w.where(F.col("w").contains("?")).distinct()
    # One lost letter: an equal key with that letter masked.  More: same length and first whole letter, then a pattern.
    masks = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring(F.col("w"), F.lit(1), i - 1), F.lit("?"), F.substring(F.col("w"), i + 1, F.length("w"))))
    single = broken.where(F.length("w") - F.length(F.replace("w", F.lit("?"), F.lit(""))) == 1)
    hit = single.join(whole.select(F.col("w").alias("found"), "n", F.explode(masks).alias("w")), "w")
    letter = lambda i: F.substring(F.col("w"), i, F.lit(1))
    several = broken.join(single, "w", "left_anti").withColumn("len", F.length("w")).withColumn("at", F.array_position(F.transform(F.sequence(F.lit(1), "len"), lambda i: letter(i) != "?"), F.lit(True)))
    # A word without any whole letter can only be looked up by its length.
    several = several.select("w", "len", "at", F.when(F.col("at") > 0, letter(F.col("at").cast("int"))).otherwise("").alias("letter"))
    places = F.transform(F.sequence(F.lit(0), F.length("w")), lambda i: F.struct(i.cast("long").alias("at"), F.when(i > 0, letter(i)).otherwise("").alias("letter")))
    more = several.join(whole.select(F.col("w").alias("found"), "n", F.length("w").alias("len"), F.explode(places).alias("p")).select("found", "n", "len", "p.*"), ["len", "at", "letter"]).where(F.forall(F.sequence(F.lit(1), F.col("len")), lambda i: (F.substring(F.col("w"), i, F.lit(1)) == "?") | (F.substring(F.col("w"), i, F.lit(1)) == F.substring(F.col("found"), i, F.lit(1)))))
    best = hit.select("w", "found", "n").unionByName(more.select("w", "found", "n")).groupBy("w").agg(F.min(F.struct(-F.col("n"), F.col("found").alias("found")))["found"].alias("repaired"))
    return broken.join(best, "w", "left").select(F.col("w").alias("word"), "repaired")


def qgram_pairs(words: DataFrame, least: float = 0.3, q: int = 4) -> DataFrame:
    """(a, b, sim), a < b, of distinct words whose padded q-gram sets have a Jaccard similarity of ``least`` or more.

    Two such sets share one of the rarest n - ceil(least * n) + 1 of each, so only those are joined; sizes and the sets
    themselves decide."""
    w = words.select("w").where("w is not null").distinct().withColumn("g", T.qgrams(F.col("w"), q))
    often = w.select(F.explode("g").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranked = w.select("w", F.size("g").alias("size"), F.explode("g").alias("x")).join(often, "x").groupBy("w", "size").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))
    prefix = ranked.select("w", "size", F.explode(F.slice("o", F.lit(1), F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1)).alias("e")).where("e.n > 1").select("w", "size", F.col("e.x").alias("x"))
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.size") >= F.col("b.size") * least - 1e-9) & (F.col("b.size") >= F.col("a.size") * least - 1e-9)
    pairs = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.w") < F.col("b.w")) & fits).select(F.col("a.w").alias("a"), F.col("b.w").alias("b")).distinct()
    both = pairs.join(w.select(F.col("w").alias("a"), F.col("g").alias("ga")), "a").join(w.select(F.col("w").alias("b"), F.col("g").alias("gb")), "b")
    return both.select("a", "b", T.jaccard(F.col("ga"), F.col("gb")).alias("sim")).where(F.col("sim") >= least)


def surname_blocks(parts: DataFrame) -> DataFrame:
    """(key, n): how many names share each surname key."""
    return parts.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def load_overrides(text: str | None) -> dict[str, list[list[str]]]:
    """merge, split and impute groups of a TOML text: groups of two or more names, splits of exactly two; none for no text."""
    found = tomllib.loads(text or "")
    good = lambda g: isinstance(g, list) and len(g) >= 2 and all(isinstance(x, str) for x in g)
    out = {k: [g for g in found.get(k, []) if good(g)] for k in ("merge", "split", "impute")}
    out["split"] = [g for g in out["split"] if len(g) == 2]
    return out


def override_edges(spark, groups: list[list[str]]) -> DataFrame:
    """(a, b): the first name of each group with each other one."""
    return spark.createDataFrame([(g[0], x) for g in groups for x in g[1:]], "a string, b string")


def consolidated_ids(groups: DataFrame, counts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(name, consolidated_id, leader) of groups (name, grp) whose names have documents (``counts``: name, doc_count).

    A group keeps the id of the leader it had before (``previous``: name, consolidated_id, leader boolean, one row a name);
    where several met, that of the largest.  A new leader gets its raw id, unless another group had it before: then the
    raw id with the first free suffix _00 to _99.
    """
    members = groups.join(counts, "name", "left").select("grp", "name", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))
    old = None
    if previous is not None:
        size = previous.groupBy("consolidated_id").agg(F.count(F.lit(1)).alias("size"))
        old = previous.where("leader").join(size, "consolidated_id").select("name", "size", F.col("consolidated_id").alias("had"))
    leaders = choose_leaders(members, old.select("name", "size") if old is not None else None).withColumnRenamed("leader", "name")
    leaders = leaders.join(raw_ids(groups.select("name")), "name")
    if old is None:
        named = leaders.withColumn("consolidated_id", F.col("raw_id"))
    else:
        leaders = leaders.join(old.select("name", "had"), "name", "left")
        taken = previous.select(F.col("consolidated_id").alias("t")).unionByName(raw_ids(groups.select("name")).select(F.col("raw_id").alias("t"))).distinct()
        base = taken.withColumn("raw_id", F.regexp_replace("t", r"^([^_]*_\d{4})_\d\d$", "$1"))
        used = base.groupBy(F.col("raw_id").alias("base")).agg(F.collect_set("t").alias("used"))
        fresh = leaders.where("had is null").join(previous.select(F.col("consolidated_id").alias("raw_id")).distinct().withColumn("lost", F.lit(True)), "raw_id", "left")
        fresh = fresh.withColumn("base", F.regexp_replace("raw_id", r"^([^_]*_\d{4})_\d\d$", "$1")).join(used, "base", "left")
        free = F.array_except(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat("base", F.lit("_"), F.lpad(i.cast("string"), 2, "0"))), F.coalesce("used", F.expr("cast(array() as array<string>)")))
        turn = F.row_number().over(Window.partitionBy("base", "lost").orderBy("name"))
        fresh = fresh.withColumn("turn", turn).withColumn("consolidated_id", F.when(F.col("lost").isNull(), F.col("raw_id")).otherwise(F.coalesce(F.get(free, F.col("turn") - 1), F.raise_error(F.lit("suffixes are used up")))))
        named = leaders.where("had is not null").select("name", "grp", F.col("had").alias("consolidated_id")).unionByName(fresh.select("name", "grp", "consolidated_id"))
    ids = named.select("grp", "consolidated_id", F.col("name").alias("_leader"))
    return groups.join(ids, "grp").select("name", "consolidated_id", (F.col("name") == F.col("_leader")).alias("leader"))
