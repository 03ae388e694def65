"""Hidden Markov language model, trained by Baum-Welch over the whole training split.

Words are counted exactly, by 64-bit hash.  The ``HEAD`` most frequent that occur ``LEAST`` times are symbols of their own; each
other word belongs to one of ``TAILS`` classes by its last letters.  A state emits a symbol; a word of the tail then follows
from its class in proportion to its count plus one, with one share for all words never seen.  HEAD is the model's
size, as the number of states is: what a worker holds is (HEAD + TAILS) x states numbers.  Counts of the unbounded
rest stay a distributed table, joined only with the texts' tail words.

Training: expected transition, start and emission counts are computed by forward-backward on each partition and
summed across partitions, for passes over all training documents until the likelihood gains less than ``TOLERANCE``
or ``PASSES`` are done.  States start from seeds: frequent words that stand in few documents together, by counts
over all training documents; each document then counts towards the seed that is most over-represented in it.
Scores are exact: the scaled forward recursion runs over each whole text, end token included.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, mix, save, text_blocks, with_fields
from .langid import split_by_crc

HEAD, TAILS = 1 << 16, 4096
LEAST = 4  # occurrences of a head word: rarer ones say more by their endings than by themselves
STATES, PASSES, TOLERANCE = 8, 3, 1e-3
SEEDS = 64  # frequent words among which the states' seeds are looked for
BLOCK_TOKENS = 150_000  # whose forward variables training holds at a time
PRIOR = 20_000.0  # tokens of the whole split's unigrams that each state's emissions start from
END = 1  # the end token's hash
FLUSH = 4_000_000


def tail_class(w: Words) -> np.ndarray:
    """0 .. TAILS-1 by the last three bytes of each word, lower-cased, with those missing as 0."""
    code = np.zeros(len(w.start), np.uint64)
    for k in range(1, 4):
        at = w.end - k
        byte = np.where(at >= w.start, LOWER[w.data[np.maximum(at, 0)]] if len(w.data) else 0, 0)
        code = code * np.uint64(256) + byte.astype(np.uint64)
    return (mix(code + np.uint64(7)) % np.uint64(TAILS)).astype(np.int64)


def count_words(documents: DataFrame) -> DataFrame:
    """(hash long, class int, n long) of all tokens of ``documents`` (text); one end token a row, of class -1."""
    schema = pa.schema([("hash", pa.int64()), ("class", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = rows = 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            c = np.concatenate([x[1] for x in held])
            n = np.concatenate([x[2] for x in held])
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c[first].astype(np.int32)), pa.array(np.bincount(inv, n).astype(np.int64))], schema=schema)

        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in text_blocks(batch.column(0)):
                w = Words(data, offsets)
                u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((u, tail_class(w)[first], n))
                size += len(u)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()
        if rows:
            yield pa.RecordBatch.from_pylist([{"hash": END, "class": -1, "n": rows}], schema=schema)

    return documents.select("text").mapInArrow(run, "hash long, class int, n long").groupBy("hash", "class").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head words, sorted by hash, with symbols 0.. in that order; the end token is one of them."""

    hashes: np.ndarray
    n: np.ndarray
    tail_mass: np.ndarray  # per class: sum of n + 1 over its words, plus 1 for all words never seen
    tokens: int
    types: int

    @property
    def symbols(self) -> int:
        return len(self.hashes) + TAILS

    def prior(self) -> np.ndarray:
        mass = np.concatenate([self.n + 1.0, self.tail_mass])
        return mass / mass.sum()


def vocabulary(words: DataFrame, head: int = HEAD, least_count: int = LEAST) -> Vocabulary:
    """The head are all words from a count on, ``least_count`` or the lowest on a logarithmic scale that leaves at most ``head`` of them, so
    that only the head and a histogram of some thousand bins reach the driver."""
    total = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    level = F.floor(F.log2("n") * 128)
    least, held = None, 1
    for r in words.where((F.col("class") >= 0) & (F.col("n") >= least_count)).groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        held += r["count"]
        if held > head:
            break
        least = r.level
    chosen = (F.col("hash") == END) & (F.col("class") == -1)
    if least is not None:
        chosen = chosen | ((level >= least) & (F.col("n") >= least_count))
    top = words.where(chosen).select("hash", "n", "class").toPandas()
    mass = np.ones(TAILS)
    for r in words.where("class >= 0").groupBy("class").agg(F.sum(F.col("n") + 1).alias("m")).collect():
        mass[r["class"]] += r.m
    own = top[top["class"] >= 0]
    np.subtract.at(mass, own["class"].to_numpy(), own["n"].to_numpy() + 1.0)
    h = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], top["n"].to_numpy(np.int64)[order], mass, int(total[0] or 0), int(total[1]))


ENCODED = "syms binary, n_tokens long, head_known long, head_log double, tails array<long>, tail_counts array<int>"


def encode(documents: DataFrame, voc: Vocabulary, carry: list[str]) -> DataFrame:
    """Per row: ``carry``, its symbols (int32), and its distinct tail words with their counts."""
    kept = documents.select(*carry, "text")
    schema = with_fields(kept.drop("text"), ENCODED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(voc.hashes)
        logs = np.log10(voc.n + 1.0)
        end = int(np.searchsorted(voc.hashes, np.uint64(END)))
        has_end = end < size and voc.hashes[end] == END
        for batch in batches:
            syms, n, known, log, tails, times = [], [], [], [], [], []
            for _, _, data, offsets in text_blocks(batch.column(len(carry))):
                w = Words(data, offsets)
                at = np.minimum(np.searchsorted(voc.hashes, w.hash), max(size - 1, 0))
                head = voc.hashes[at] == w.hash if size else np.zeros(len(w.hash), bool)
                sym = np.where(head, at, size + tail_class(w))
                for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                    inside = head[a:b]
                    x = at[a:b][inside]
                    syms.append(np.append(sym[a:b], end if has_end else size).astype(np.int32).tobytes())
                    n.append(b - a + 1)
                    known.append(len(x) + has_end)
                    log.append(float(logs[x].sum() + (logs[end] if has_end else 0.0)))
                    u, c = np.unique(w.hash[a:b][~inside], return_counts=True)
                    tails.append(u.view(np.int64))
                    times.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(syms, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(log, pa.float64()), pa.array(tails, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], [*carry, "syms", "n_tokens", "head_known", "head_log", "tails", "tail_counts"])

    return kept.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


# --------------------------------------------------------------------------- the model
@dataclass
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K, single precision


def _groups(seqs: list[np.ndarray], rows: int = 1024, tokens: int = BLOCK_TOKENS) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences, longest first, in groups: their places, symbols time by time, and how many go on at each time."""
    order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
    a = 0
    while a < len(order):
        b, held = a, 0
        while b < len(order) and b - a < rows and (b == a or held + len(seqs[order[b]]) <= tokens):
            held += len(seqs[order[b]])
            b += 1
        own = order[a:b]
        lengths = np.array([len(seqs[k]) for k in own])
        flat = np.concatenate([seqs[k] for k in own])
        time = np.concatenate([np.arange(n) for n in lengths])
        flat = flat[np.argsort(time, kind="stable")]
        width = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # with more than t symbols
        yield own, flat.astype(np.int64), width
        a = b


def log_likelihood(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    for own, flat, width in _groups(seqs):
        total, at, alpha = np.zeros(len(own)), 0, None
        for n in width:
            e = model.emit[flat[at : at + n]]
            alpha = model.start * e if alpha is None else (alpha[:n] @ model.move) * e
            c = alpha.sum(axis=1)
            total[:n] += np.log10(c)
            alpha /= c[:, None]
            at += n
        out[own] = total
    return out


def _forward(model: Hmm, e: np.ndarray, width: np.ndarray, before: np.ndarray | None, keep: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(scaled forward variables of the last time, those of all times, all scales) for emissions ``e`` along ``width``,
    from the variables of the time before, or the start."""
    alpha, scale = (np.empty(e.shape), np.empty(len(e))) if keep else (None, None)
    at = 0
    for n in width:
        before = (model.start if before is None else before[:n] @ model.move) * e[at : at + n]
        c = before.sum(axis=1)
        before /= c[:, None]
        if keep:
            alpha[at : at + n], scale[at : at + n] = before, c
        at += n
    return before, alpha, scale


def expected_counts(model: Hmm, seqs: list[np.ndarray], emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Baum-Welch: (start counts, transition counts, log10 likelihood); emission counts are added to ``emit``.

    Long sequences are gone through in blocks of ``BLOCK_TOKENS``: a first sweep keeps the forward variables at the
    blocks' ends, from which those inside a block are made again on the way back.  So counts don't depend on length.
    """
    k = len(model.start)
    start, move, log = np.zeros(k), np.zeros((k, k)), 0.0
    for _, flat, width in _groups(seqs):
        ends = np.cumsum(width)
        cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_TOKENS)) + 1), len(width)]
        blocks = [(slice(ends[a] - width[a], ends[b - 1]), width[a:b]) for a, b in itertools.pairwise(cuts)]
        heads: list = [None]
        for at, wide in blocks[:-1]:
            heads.append(_forward(model, model.emit[flat[at]].astype(float), wide, heads[-1], False)[0])
        after = None  # emission times beta over scale, of the first time after the block
        for (at, wide), head in zip(reversed(blocks), reversed(heads), strict=True):
            own = flat[at]
            e = model.emit[own].astype(float)
            last, alpha, scale = _forward(model, e, wide, head)
            log += float(np.log10(scale).sum())
            if after is not None:
                move += last[: len(after)].T @ after
            e /= scale[:, None]  # and then times beta
            gamma, p = alpha.copy(), len(own)
            for n in wide[::-1]:
                p -= n
                if after is not None:
                    m = len(after)
                    beta = after @ model.move.T
                    gamma[p : p + m] *= beta
                    e[p : p + m] *= beta
                after = e[p : p + n]
            # A symbol's predecessor stands as many places before it as sequences go on at the time before.
            first = wide[0]
            move += alpha[np.arange(first, len(own)) - np.repeat(wide[:-1], wide[1:])].T @ e[first:]
            gamma /= gamma.sum(axis=1, keepdims=True)
            if head is None:
                start += gamma[:first].sum(axis=0)
            used, places = np.unique(own, return_inverse=True)
            sums = np.bincount((places[:, None] * k + np.arange(k)).ravel(), gamma.ravel(), len(used) * k)
            emit[used] += sums.reshape(-1, k)
    return start, model.move * move, log


def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
    emit = emit + PRIOR * prior[:, None]
    move = move + 1.0 + 9.0 * np.eye(len(start))
    return Hmm((start + 1) / (start + 1).sum(), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=0)).astype(np.float32))


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.int32) for x in column]


def _summed(encoded: DataFrame, k: int, of_batch: Callable[[list[np.ndarray], dict], None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows of k columns): symbols' emission counts and, with ids from -1 down, other rows, filled in for each
    partition by ``of_batch`` (``emit`` and ``rest`` of its dict) and summed across partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                of_batch(_sequences(batch.column(0)[a : a + 2048]), found)
        if found:
            emit, rest = found.get("emit", np.zeros((0, k))), found.get("rest", np.zeros((0, k)))
            used = np.flatnonzero(emit.any(axis=1))
            rows = np.concatenate([emit[used], rest])
            ids = np.concatenate([used, -1 - np.arange(len(rest))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(rows[:, j]) for j in range(k))], ["id", *(f"s{j}" for j in range(k))])

    counts = encoded.select("syms").mapInArrow(run, "id long, " + ", ".join(f"s{j} double" for j in range(k)))
    total = counts.groupBy("id").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toPandas()
    ids, values = total["id"].to_numpy(np.int64), total[[f"s{j}" for j in range(k)]].to_numpy(float)
    return ids, values


def _placed(summed: tuple[np.ndarray, np.ndarray], size: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of ``size`` emission rows and ``rest`` other rows, zero where nothing was summed."""
    ids, values = summed
    out = np.zeros((size + rest, values.shape[1]))
    out[np.where(ids >= 0, ids, size - 1 - ids)] = values
    return out[:size], out[size:]


def seeded(encoded: DataFrame, voc: Vocabulary, states: int) -> Hmm:
    """The first model.  Of the ``SEEDS`` most frequent head words, counted by the documents they stand in alone and in
    pairs, the first seed is the one in most documents, each next one that with the least share of documents in
    common with any seed before it.  A document belongs to the seed of the greatest count relative to the seed's own in
    all documents, the first of equals; emissions are counted by these."""
    prior, size = voc.prior(), voc.symbols
    head = np.flatnonzero(voc.hashes != np.uint64(END))
    some = head[np.lexsort((voc.hashes[head], -voc.n[head]))][:SEEDS]
    if not len(some):
        return from_counts(np.ones(states), np.eye(states), np.zeros((size, states)), prior)
    place = np.full(size, -1)
    place[some] = np.arange(len(some))
    m = len(some)

    def together(seqs: list[np.ndarray], found: dict) -> None:
        x = np.zeros((len(seqs), m), np.float32)
        for row, s in zip(x, seqs, strict=True):
            p = place[s]
            row[p[p >= 0]] = 1
        found["rest"] = found.get("rest", 0) + (x.T @ x).astype(float)

    both = _placed(_summed(encoded, m, together), 0, m)[1]
    alone = np.maximum(both.diagonal(), 1.0)
    share = both / np.minimum(alone[:, None], alone[None])
    # Words of few documents would always be the farthest: a seed stands in a 2 * states-th of them at least, if that many do.
    able = np.flatnonzero(both.diagonal() >= both.diagonal().max() / (2 * states))
    seeds = [int(able[both.diagonal()[able].argmax()])]
    while len(seeds) < min(states, len(able)):
        near = share[np.ix_(able, seeds)].max(axis=1)
        near[np.isin(able, seeds)] = 2
        seeds.append(int(able[near.argmin()]))
    chosen, often = some[seeds], voc.n[some[seeds]].astype(float)

    def by_seed(seqs: list[np.ndarray], found: dict) -> None:
        emit = found.setdefault("emit", np.zeros((size, states)))
        lengths = np.array([len(s) for s in seqs])
        flat = np.concatenate(seqs)
        owner = np.repeat(np.arange(len(seqs)), lengths)
        over = np.array([np.bincount(owner, flat == c, len(seqs)) for c in chosen]) / often[:, None]
        state = over.argmax(axis=0)[owner]
        key, n = np.unique(flat.astype(np.int64) * states + state, return_counts=True)
        emit.reshape(-1)[key] += n

    emit = _placed(_summed(encoded, states, by_seed), size, 0)[0]
    return from_counts(emit.sum(axis=0), np.eye(states) * 11, emit, prior)  # each lasts for some 20 / states tokens


def baum_welch_pass(encoded: DataFrame, model: Hmm, prior: np.ndarray) -> tuple[Hmm, float]:
    """(the model after one pass over ``encoded`` (syms), log10 likelihood of the one before): counts of each partition,
    summed by symbol across partitions."""
    k, size = len(model.start), len(prior)

    def count(seqs: list[np.ndarray], found: dict) -> None:
        s, m, log = expected_counts(model, seqs, found.setdefault("emit", np.zeros((size, k))))
        found["rest"] = found.get("rest", 0) + np.concatenate([m, s[None], np.full((1, k), log)])

    emit, rest = _placed(_summed(encoded, k, count), size, k + 2)
    return from_counts(rest[k], rest[:k], emit, prior), float(rest[k + 1, 0])


def train(encoded: DataFrame, voc: Vocabulary, states: int = STATES, passes: int = PASSES, tolerance: float = TOLERANCE) -> Hmm:
    """Seeds, then Baum-Welch passes over all rows of ``encoded`` (syms)."""
    prior, last = voc.prior(), None
    model = seeded(encoded, voc, states)
    for _ in range(passes):
        model, log = baum_welch_pass(encoded, model, prior)
        if last is not None and log - last <= tolerance * abs(last):
            break
        last = log
    return model


@dataclass
class Fitted:
    words: DataFrame
    vocabulary: Vocabulary
    encoded: DataFrame
    model: Hmm


def fit(documents: DataFrame, head: int = HEAD, **options) -> Fitted:
    """Counts, vocabulary and model from the rows of ``documents`` (doc_id, text, held_out) that aren't held out; all rows
    are encoded."""
    rows = documents.select("doc_id", "held_out", "text")
    words = save(count_words(rows.where("not held_out")), "words")
    voc = vocabulary(words, head)
    encoded = save(encode(rows, voc, ["doc_id", "held_out"]), "encoded")
    return Fitted(words, voc, encoded, train(encoded.where("not held_out"), voc, **options))


def score(fitted: Fitted) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    words, voc, encoded, model = fitted.words, fitted.vocabulary, fitted.encoded, fitted.model
    tail = encoded.select("row", F.explode(F.arrays_zip("tails", "tail_counts")).alias("t")).select("row", F.col("t.tails").alias("hash"), F.col("t.tail_counts").alias("k"))
    known = tail.join(words.select("hash", "n"), "hash").groupBy("row").agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("tail_log"))

    size = len(voc.hashes)
    offset = np.concatenate([np.zeros(size), np.log10(voc.tail_mass)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 2048):
                seqs = _sequences(batch.column(6)[a : a + 2048])
                found.append(log_likelihood(model, seqs) - np.array([offset[s].sum() for s in seqs]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.concatenate(found) if found else [], pa.float64())], [*batch.schema.names[:6], "forward"])

    kept = encoded.select("row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "syms")
    done = kept.mapInArrow(run, with_fields(kept.drop("syms"), "forward double")).join(known, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * float(np.log10(voc.tokens + voc.types + 1))
    return done.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("forward") + tail_log).alias("score"))


def score_documents(documents: DataFrame, **options) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score; the model is learned from the rows that aren't held out.

    Null text is empty, which is one end token; very long texts are counted and scored whole; rows repeated count as
    often as they are there; words of equal counts are in the head or the tail together; without training rows all
    tokens are unknown; an empty table gives no rows.  Doc_ids may be null and needn't be unique.  Other columns,
    whatever their names, are ignored.
    """
    return score(fit(documents, **options))


def op4_hmm(spark, sf_dir: str) -> DataFrame:
    return score_documents(split_by_crc(spark.read.parquet(f"{sf_dir}/documents.parquet"), 7, 2))
