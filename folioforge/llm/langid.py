"""Language identification by the nearest of several clustered centroids per language.

A text is a TF-IDF vector over hashed byte trigrams (A-Z lower-cased), with log(1 + tf), of length one.  For each
language, spherical k-means over a bounded sample of labelled documents gives some centroids; a text gets the
language of the centroid of greatest cosine, and is rejected if that cosine is below the centroid's own radius.

The bound of the sample is ``sample`` documents in all, shared evenly by the languages; every other document is
only scored, by a model of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, small_batches, text_blocks, with_fields

DIMS_LOG2 = 13
DIMS = 1 << DIMS_LOG2
SAMPLE = 2000
MOST_LANGS = 500  # a bound of the sample, for a lang column of very many values
CENTROIDS = 3
SLACK = 0.2
UNKNOWN = "und"
FOLD = LOWER.copy()  # ASCII other than letters is blank
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
LETTER = regex.compile(r"\p{L}")


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts (texts x DIMS) of some texts, with one blank before, after and between words of letters."""
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    for k in range(len(offsets) - 1):
        x = np.concatenate(([32], FOLD[data[offsets[k] : offsets[k + 1]]], [32]))
        x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))].astype(np.uint32)
        for a in range(0, len(x) - 2, 1 << 20):
            y = x[a : a + (1 << 20) + 2]
            code = (y[:-2] << np.uint32(16)) | (y[1:-1] << np.uint32(8)) | y[2:]
            bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - DIMS_LOG2)
            out[k] += np.bincount(bucket, minlength=DIMS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    radius: np.ndarray  # least cosine that isn't rejected

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = unit(np.log1p(counts(data, offsets)) * self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        return best, np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)


def fit(texts: list[str], langs: list[str], centroids: int = CENTROIDS, slack: float = SLACK, rounds: int = 8) -> Model:
    """Deterministic: k-means starts from the first text and goes on to the farthest."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    tf = counts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 1
    x = np.log1p(tf, out=tf)  # in place: the sample's vectors are the driver's largest object
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    tags, found, of, radius = np.array(langs), [], [], []
    for lang in sorted(set(langs)):
        own = x[tags == lang]
        c = [own[0]]
        while len(c) < min(centroids, len(own)):
            c.append(own[(own @ np.array(c).T).max(axis=1).argmin()])
        c = np.array(c)
        for _ in range(rounds):
            near = (own @ c.T).argmax(axis=1)
            c = unit(np.array([own[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))]))
        cos = own @ c.T
        near = cos.argmax(axis=1)
        for k in range(len(c)):
            mine = cos[near == k, k]
            found.append(c[k])
            of.append(lang)
            radius.append(slack * float(mine.min()) if len(mine) else 0.0)
    return Model(idf, np.array(found, np.float32).reshape(-1, DIMS), of, np.array(radius))


def train(labelled: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """Fit on at most about ``sample`` rows of ``labelled`` (doc_id, text, lang; nulls left out), evenly by
    language, chosen by a hash of doc_id and text.  Only the ``MOST_LANGS`` languages of most rows are learned."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGS).collect()}
    each = max(1, sample // max(1, len(size)))
    shares = F.create_map(*[F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, 1.2 * each / n))]) if size else None
    share = F.coalesce(shares[F.col("lang")], F.lit(0.0)) if size else F.lit(0.0)
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked: dict[str, list] = {}
    for r in rows.withColumn("_at", at).where(F.col("_at") < share).select("_at", "lang", "text").collect():
        picked.setdefault(r.lang, []).append((r[0], r.text))
    texts, langs = [], []
    for lang in sorted(picked):
        for _, t in sorted(picked[lang])[:each]:
            texts.append(t)
            langs.append(lang)
    return fit(texts, langs, **options) if texts else Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with lang_pred, lang_score (cosine, 0 to 1) and lang_rejected.

    Null text and text without a letter is ``und``, with score 0, and rejected; so is everything if nothing was
    learned.  Ties go to the first centroid in order of language.  Columns of these names are replaced.
    """
    added = ["lang_pred", "lang_score", "lang_rejected"]
    documents = documents.drop(*added)
    schema = with_fields(documents, "lang_pred string, lang_score double, lang_rejected boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            letters = np.array([t.is_valid and LETTER.search(t.as_py()) is not None for t in texts], bool)
            pred, score, bad = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~letters
            if model.langs:
                for a, b, data, offsets in text_blocks(texts, 1 << 20):
                    for k in range(0, b - a, 128):
                        n = min(128, b - a - k)
                        best, cos = model.score(data, offsets[k : k + n + 1])
                        for j in np.flatnonzero(letters[a + k : a + k + n]):
                            row = a + k + j
                            pred[row], score[row], bad[row] = model.langs[best[j]], cos[j], cos[j] < model.radius[best[j]]
            else:
                bad[:] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(bad)], [*batch.schema.names, *added])

    return small_batches(documents).mapInArrow(run, schema)


def split_by_crc(documents: DataFrame, modulus: int, rest: int) -> DataFrame:
    """``documents`` with held_out: crc32 of doc_id as text, modulo ``modulus``, is ``rest``; false for null."""
    return documents.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False)))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = split_by_crc(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), 4, 2)
    model = train(docs.where(~F.col("held_out")))
    out = identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
