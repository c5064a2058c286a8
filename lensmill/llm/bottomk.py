"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles (five words; words are cut at ASCII white
space; a shorter text is one shingle). Sketches merge: the sketch of a union of parts is the k smallest of their
hashes. Resemblance is the share of the k smallest of the union that both hold; containment and the number of
distinct shingles follow from the k-th smallest hash.

Defined results: null text is empty; a text without words has an empty sketch, written ''; two empty sketches are
alike 1, an empty and another 0; equal texts have equal sketches; rows with the same id are ordered by a hash of the
text, null ids come last (those of the largest long among them); repeated rows are rows of their own, each the next of the other; a single row is its own next;
an empty table gives an empty result; other columns are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import materialise, rows_of, short, to_batch
from lensmill.llm.sharding import MAX_RANGES, ORDER, OVERHEAD, SAMPLES_PER_RANGE, drawn, quantiles, ranged

K, WORDS = 128, 5
#: Rows that repeat id and text are walked as one beyond this and a range's share.
LARGE_ROWS = 1_000
_MEMO: dict[bytes, int] = {}
MEMO_ENTRIES = 400_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    memo = _MEMO
    try:
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        hashed = xxhash.xxh64_intdigest
        for w in words:
            if w not in memo:
                memo[w] = hashed(w, 7)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """A mixed hash of each run of ``width`` word hashes; of the whole if there are fewer."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, np.uint64(min(width, len(words))))
    for i in range(min(width, len(words))):
        h = (h ^ words[i : i + n]) * _ODD[0]
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(30))) * _ODD[2]
    h = (h ^ (h >> np.uint64(27))) * _ODD[3]
    return h ^ (h >> np.uint64(31))


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:
        few = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketch(text: str, k: int = K) -> np.ndarray:
    return bottom(shingle_hashes(word_hashes(text.encode().split())), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Exact below k; else (k - 1) over the k-th smallest hash as a fraction."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return float(min(1.0, both / distinct_shingles(a, k)))


def spelled(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def unspelled(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated) of every row; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_shingles", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            found = [(i, sketch(t or "", k)) for i, t in rows_of(batch, "doc_id", "text")]
            yield to_batch(schema, [[i for i, _ in found], [spelled(s) for _, s in found], [distinct_shingles(s, k) for _, s in found]])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string, n_shingles double")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def compared_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    Rows that share an id are put in order by a hash of the text, so one id's rows lie in as many ranges as they fill.
    Rows that repeat id and text are a group; groups are counted first, and a weighted sample of them gives splitters
    into ranges of similar bytes (4 a shuffle partition). A group that holds more rows than a range should is walked
    once and written as often as it is there. Each range's first text is also sent to the range before it. Texts are
    then shuffled once, and each task walks its ranges in order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = min(MAX_RANGES, 4 * parts)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumns({"key": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "id": F.xxhash64("text", F.col("doc_id").isNull()), "uid": F.lit(0).cast("long")})
    groups = docs.groupBy(*ORDER).agg(F.count("*").alias("n"), F.max(F.octet_length("text") + OVERHEAD).cast("long").alias("size"))
    groups = materialise(groups, "sketch-groups")
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    chance = F.col("size") * F.lit(pieces * SAMPLES_PER_RANGE / max(1, sums.size))
    cuts = sorted(set(quantiles(drawn(groups, chance, 1), pieces)))
    large = max(LARGE_ROWS, sums.n // pieces)
    placed = ranged(groups, cuts)
    firsts = sorted((r.rng, *r.head) for r in placed.groupBy("rng").agg(F.min(F.struct(*ORDER[:2])).alias("head")).collect())
    # At most a row a range: each range's first group and the range that borrows its text, the first range's going to the last.
    heads = [(key, mark, firsts[i - 1][0]) for i, (_, key, mark) in enumerate(firsts)]
    lent = spark.createDataFrame(heads, "head_key bigint, head_id bigint, lent int")
    # More rows than a range should hold: fewer groups than ranges.
    several = placed.where(F.col("n") > large).select(F.col("key").alias("head_key"), F.col("id").alias("head_id"), F.col("rng").alias("own"), "n")
    same = lambda t: (docs["key"] == t["head_key"]) & (docs["id"] == t["head_id"])
    singles = ranged(docs.join(F.broadcast(several), same(several), "left_anti"), cuts).select("doc_id", "text", *ORDER[:2], "rng", F.lit(0).alias("borrowed"), F.lit(1).cast("long").alias("times"))
    one_text = F.any_value("text").alias("text"), F.any_value("doc_id").alias("doc_id")
    repeated = docs.join(F.broadcast(several), same(several)).groupBy(*ORDER[:2], "own", "n").agg(*one_text)
    repeated = repeated.select("doc_id", "text", *ORDER[:2], F.col("own").alias("rng"), F.lit(0).alias("borrowed"), F.col("n").alias("times"))
    borrowed = docs.join(F.broadcast(lent), same(lent)).groupBy(*ORDER[:2], "lent").agg(*one_text)
    borrowed = borrowed.select("doc_id", "text", *ORDER[:2], F.col("lent").alias("rng"), F.lit(1).alias("borrowed"), F.lit(1).cast("long").alias("times"))
    sorted_rows = singles.unionAll(repeated).unionAll(borrowed).repartition(parts, "rng").sortWithinPartitions("rng", "borrowed", *ORDER[:2])
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_containment", "n_shingles"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def described(text: str, words: np.ndarray, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
        changed = edited(text, following)
        kept = len(text) - len(text) // 4
        if changed == text:
            other = own
        else:
            head = text[:kept].encode().split()
            same = max(0, len(head) - 1)  # the last word may run on into the new part
            tail = (head[-1] if head and not text[kept - 1 : kept].encode().isspace() else b"") + (b"" if head and not text[kept - 1 : kept].encode().isspace() else (head[-1] + b" " if head else b"")) + changed[kept:].encode()
            other = bottom(shingle_hashes(np.concatenate([words[:same], word_hashes(tail.split())])), k)
        return len(text), hashlib.sha256(changed.encode()).hexdigest(), spelled(own), spelled(other), resemblance(own, other, k), resemblance(own, after, k), containment(own, other, k), distinct_shingles(own, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[list] = [[] for _ in names]
        for batch in short(batches):
            for doc_id, text, borrowed, times in rows_of(batch, "doc_id", "text", "borrowed", "times"):
                words = word_hashes(text.encode().split())
                own = bottom(shingle_hashes(words), k)
                if held is not None:
                    for column, value in zip(out, (held[0], *described(held[1], held[2], held[3], text, own)), strict=True):
                        column.append(value)
                held = None if borrowed else (doc_id, text, words, own)
                if times > 1:  # all but the last are each other's next
                    row = (doc_id, *described(text, words, own, text, own))
                    for at in range(0, times - 1, 256):
                        yield to_batch(schema, [[v] * min(256, times - 1 - at) for v in row])
            if len(out[0]) >= 256:
                yield to_batch(schema, out)
                out = [[] for _ in names]
        if out[0]:
            yield to_batch(schema, out)

    ddl = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_containment double, n_shingles double"
    return sorted_rows.mapInArrow(run, ddl)


__all__ = ["compared_with_next", "containment", "distinct_shingles", "edited", "merge", "resemblance", "sketch", "sketches", "spelled", "unspelled"]
