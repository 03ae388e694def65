"""BPE encoding and decoding of a published word-end tokenizer file.

A word's symbols stay where they are, in one string.  Two contiguous arrays describe its parts: their boundaries, and
the rank of each adjacent pair.  A scan finds the lowest rank; its boundary is deleted and the two neighbouring
ranks are refreshed.  Words longer than ``SCAN_MOST`` symbols, where scans would take quadratic time, go through a
heap over the same boundaries that makes the same merges in the same order.  Finished words are kept in two tables of bounded size: when the young one is full it becomes the old
one, and words still in use are taken over, so frequent words stay while rare ones pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

CACHE_WORDS = 120_000
CACHE_LONGEST = 64
SCAN_MOST = 256
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = [], 0x100
    for b in range(256):
        table.append(chr(b if b in shown else spare))
        spare += b not in shown
    return table


class WordBpe:
    """The parts of a tokenizer file that it has to have: NFC, white space to one space, lower case; pieces by the
    file's pattern; byte-level letters; BPE with a word-end mark; special tokens found in the raw text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"] is not None or model["byte_fallback"] or model["dropout"]:
            raise ValueError(f"{path} is of another kind")
        if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take white space, or only whole words or normalised text")
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.letters = byte_letters()
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def normalise(self, text: str) -> str:
        """NFC and lower case.  White space stays as it is: no piece has any, and each run of it parts pieces as one
        space would."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if "Σ" not in text:
            return text.lower()
        return "σ".join(part.lower() for part in text.split("Σ"))  # letter by letter: no final sigma

    def merge(self, symbols: str, bounds: list[int]) -> list[int]:
        """The boundaries that are left of ``bounds`` (0, ..., len(symbols)); the list is changed in place."""
        if len(bounds) - 1 > SCAN_MOST:
            return self._merge_long(symbols, bounds)
        find = self.ranks.get
        ranks = [find((symbols[a:b], symbols[b:c]), NEVER) for a, b, c in zip(bounds, bounds[1:], bounds[2:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            k = ranks.index(low)
            del bounds[k + 1], ranks[k]
            a, b = bounds[k], bounds[k + 1]
            if k < len(ranks):
                ranks[k] = find((symbols[a:b], symbols[b : bounds[k + 2]]), NEVER)
            if k:
                ranks[k - 1] = find((symbols[bounds[k - 1] : a], symbols[a:b]), NEVER)
        return bounds

    def _merge_long(self, symbols: str, bounds: list[int]) -> list[int]:
        n, find = len(bounds) - 1, self.ranks.get
        end = bounds[1:]  # of the part that begins at boundary k; 0 once the boundary is deleted
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(k: int) -> tuple[str, str] | None:
            return (symbols[bounds[k] : end[k]], symbols[end[k] : end[after[k]]]) if after[k] < n else None

        heap = [(r, k, p) for k in range(n - 1) if (r := find(p := pair(k))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, p = heapq.heappop(heap)
            if not end[k] or pair(k) != p:
                continue
            gone = after[k]
            end[k], end[gone], after[k] = end[gone], 0, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for j in (k, before[k]):
                if j >= 0 and (q := pair(j)) is not None and (r := find(q)) is not None:
                    heapq.heappush(heap, (r, j, q))
        return [b for b, e in zip(bounds, end, strict=False) if e] + [bounds[-1]]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a piece of text; a part that the vocabulary lacks gives none."""
        raw = word.encode("utf-8", "surrogatepass")
        symbols = "".join([self.letters[b] for b in raw]) + self.end
        bounds = self.merge(symbols, [*range(len(raw)), len(symbols)])
        found = (self.vocab.get(symbols[a:b]) for a, b in itertools.pairwise(bounds))
        return [i for i in found if i is not None]

    def word(self, word: str) -> tuple[str, str, int]:
        """A word's ids and tokens, each joined by blanks, and their number."""
        found = self.old.get(word)
        if found is None:
            ids = self.encode_word(word)
            found = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        if len(word) <= CACHE_LONGEST:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary text, and special tokens, in turn."""
        at = 0
        if self.special_pattern is not None and any(t in text for t in self.special):
            for m in self.special_pattern.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for part, special in self._segments(text or ""):
            for word in self.pieces.findall(self.normalise(part)) if part else ():
                ids += self.encode_word(word)
            if special is not None:
                ids.append(special)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids and of the decoded text: as of encode() and decode(), word by word."""
        ids: list[str] = []
        shown: list[str] = []
        n = 0
        make = self.word
        for part, special in self._segments(text or ""):
            if part:
                words = [self.young.get(w) or make(w) for w in self.pieces.findall(self.normalise(part))]
                ids += [w[0] for w in words if w[2]]
                shown += [w[1] for w in words if w[2]]
                n += sum([w[2] for w in words])
            if special is not None:
                ids.append(str(special))
                shown.append(self.tokens[special])
                n += 1
        sha = lambda x: hashlib.sha256(" ".join(x).encode("utf-8", "surrogatepass")).hexdigest()
        return n, sha(ids), sha(shown)


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One per worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; ids are joined by one space before hashing.

    Null text is empty and has no tokens; a null doc_id is kept; repeated rows are each returned; whole texts are
    encoded, whatever their length, in time that grows by n log n in a word's; an empty table gives no rows; other columns,
    whatever their names, are ignored.  ``path`` is read on the executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or default_path())
        for batch in batches:
            n, a, b = zip(*map(bpe.digests, (x.as_py() for x in batch.column(1))), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string of each row, in all cases as :func:`token_digests`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or default_path())
        for batch in batches:
            ids = [bpe.encode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
