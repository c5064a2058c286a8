"""Language identification by nearest centroid: TF-IDF n-gram vectors, several clustered centroids per language.

A text is lower-cased; ASCII characters that are no letters count as spaces; n-grams of 1 to 4 UTF-8 bytes are
hashed into a fixed number of dimensions, weighted by TF-IDF and normalised. Spherical k-means clusters the vectors
of each language. The nearest centroid by cosine gives the language; a text farther from it than that centroid's
radius (a quantile of its own training texts, widened) is marked as rejected.

The fit uses at most ``per_lang`` labelled rows of each language and ``max_rows`` in all, chosen by a hash of the id, so
it is bounded and the same in every run; every row is scored, over its whole text, without a shuffle.

Defined results: a null text or one without a letter gives ``und`` with score 0, so does a table with no usable
training row; ties between centroids go to the language first by code point; null languages teach nothing; repeated
rows are scored each; other columns are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensmill.llm.common import held_out, rows_of, short, stretch, to_batch, trained

DIMENSIONS, GRAMS = 4096, (1, 2, 3, 4)
UNKNOWN = "und"
#: Rows that a fit reads at most; its vectors take 16 KB each.
MAX_ROWS = 20_000
_LETTER = re.compile(r"[^\W\d_]").search
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MULTIPLIER = np.uint32(2654435761)


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the whole text."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    total, code = np.zeros(DIMENSIONS, np.float32), np.zeros(len(raw), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(raw) < n:
            break
        code = code[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            total += np.bincount((code * _MULTIPLIER) >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = counts * self.idf
        norms = np.linalg.norm(weighted, axis=1, keepdims=True)
        return weighted / np.where(norms == 0, 1, norms)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        known = [i for i, t in enumerate(texts) if t and _LETTER(t)] if self.languages else []
        langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if known:
            cosines = self.vectors(np.stack([gram_counts(texts[i]) for i in known])) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for i, row, k in zip(known, cosines, best, strict=True):
                langs[i], scores[i] = self.languages[self.owner[k]], float(min(1, max(0, row[k])))
                rejected[i] = bool(1 - row[k] > self.radius[k])
        return langs, scores, rejected


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts with the mean and, each time, the vector farthest from the centroids so far."""
    centroids = [x.mean(axis=0)]
    while len(centroids) < min(k, len(x)):
        centroids.append(x[(x @ np.stack(centroids).T).max(axis=1).argmin()])
    c = np.stack(centroids)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        owner = (x @ c.T).argmax(axis=1)
        c = np.stack([x[owner == i].mean(axis=0) if (owner == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def sample(documents: DataFrame, per_lang: int = 300, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, lang, pick, nth of at most per_lang rows of each language that are not held out, by a hash of the id.

    Rows of one id and language count once and give their least text, however many they are.
    The choice reads ids and languages only, ranked first within salted parts of a language, so that one with a third
    of all rows does not meet in one task. Beyond max_rows in all, each language gives its first rows by turns. The
    chosen ids are broadcast (max_rows at most) and pick their texts in one scan without a shuffle of texts.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = known.select("lang", F.col("doc_id").alias("pick_id"), F.xxhash64("doc_id").alias("pick")).distinct()
    ids = ids.withColumn("salt", F.pmod("pick", F.lit(64)))
    for part in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("pick", "pick_id"))
        ids = ids.withColumn("nth", rank).where(F.col("nth") <= per_lang)
    chosen = ids.select("pick_id", "pick", "nth", F.col("lang").alias("taught")).orderBy("nth", "pick", "pick_id", "taught").limit(max_rows)
    texts = documents.select("doc_id", "text", "lang")
    texts = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("pick_id")) & (F.col("lang") == F.col("taught")))
    return texts.groupBy("lang", "pick", "pick_id", "nth").agg(F.min("text").alias("text")).select("text", "lang", "pick", "nth")


def fit(labelled: DataFrame, clusters: int = 3, max_rows: int = MAX_ROWS, max_chars: int = 20_000, widen: float = 1.5) -> LanguageModel:
    """labelled: text, lang and the order columns ``nth`` and ``pick``, as sample() gives them.

    Bounds: max_rows rows, in that order, and of a longer text max_chars code points from a hashed place. The fit runs
    in one task.
    """
    few = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    few = few.select("lang", "pick", stretch("text", "pick", max_chars).alias("text"), "nth").orderBy("nth", "pick", "lang", F.xxhash64("text")).limit(max_rows)
    return trained(few.drop("nth"), lambda rows: fit_rows(rows, clusters, widen))


def fit_rows(rows: list[tuple[str, int, str]], clusters: int, widen: float) -> LanguageModel:
    """The fit itself, of (lang, pick, text)."""
    rows = sorted(rows)
    if not rows:
        empty = np.zeros((0, DIMENSIONS), np.float32)
        return LanguageModel((), np.ones(DIMENSIONS, np.float32), empty, np.zeros(0, int), np.zeros(0))
    counts = np.stack([gram_counts(t) for _, _, t in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    languages = tuple(sorted({r[0] for r in rows}))
    model = LanguageModel(languages, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    x, lang = model.vectors(counts), np.array([languages.index(r[0]) for r in rows])
    parts = [_clusters(x[lang == i], clusters) for i in range(len(languages))]
    centroids, owner = np.concatenate(parts), np.concatenate([[i] * len(p) for i, p in enumerate(parts)])
    cosines = x @ centroids.T
    cosines[owner[None, :] != lang[:, None]] = -1
    near = cosines.argmax(axis=1)
    radius = np.array([widen * np.quantile(1 - cosines[near == k, k], 0.995) if (near == k).any() else 1.0 for k in range(len(centroids))])
    return LanguageModel(languages, idf, centroids.astype(np.float32), owner, radius)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t for (t,) in rows_of(part, "text")]
                yield to_batch(schema, [part.column(0).to_pylist(), *model.predict(texts)])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
