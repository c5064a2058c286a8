"""Suffix-array deduplication of repeated byte strings, exact at ``length`` bytes (100).

A byte goes if it lies in a 100-byte string that also starts earlier (smaller id, or same document and earlier start).
Sorting all suffixes of a corpus would shuffle a hundred times its size, so a sparse suffix array is built: in each
window of 100 bytes the 24-byte gram of least hash marks one suffix. Equal windows mark the same gram at the same
offset, so windows need comparing only if their suffixes share a gram. One suffix in some 38 is kept.

1. Each task lists its suffixes: leading 8 bytes, hash of the gram (48 bits), hash of all bytes that the suffix's windows
   cover (64 bits), document, position, window starts. Suffixes alike in all three within a chunk are merged at once: the
   first stays.
2. Sampled splitters on (lead, gram, context) range-partition the suffixes, so a frequent gram spreads over buckets. A
   bucket is sorted by multikey quicksort. Of suffixes with equal context all but the first are settled: their
   windows repeat. Contexts that differ under one gram are open; a gram that reaches a bucket's boundary counts as
   open too, which compares it across the boundary.
3. The windows of open suffixes are hashed one by one (96 bits). Of a chunk's equal windows only the first is partitioned by
   hash, so a passage that a third of all documents share reaches its bucket once a chunk; there all but the first repeat.
4. The repeats of each document are merged and cut out.

Work and volume grow linearly with the text, whatever the groups of copies. Texts are shuffled only for documents
with open suffixes (step 3) and documents cut in part (step 4); their ids are broadcast to filter the scan while
there are at most BROADCAST_IDS of them, beyond that the join itself does it. A bucket stands for BUCKET_BYTES of text
at most, so that more text means more buckets and not larger ones. If ids repeat or are null, texts are numbered and stored
once before step 1.

Equality is judged by hashes. Among g distinct contexts of one gram and lead two agree by chance with some g^2 / 2^65: 3e-8
for a million of them. Among n open windows it is n^2 / 2^97: 6e-12 for a billion.

Defined results: null text is empty; texts under 100 bytes lose nothing; rows that repeat an id and its text are one
document and get the same result; rows that repeat an id with different texts are ordered by the text's SHA-256;
null ids come last; an empty table gives an empty result; other columns are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import materialise, release, rows_of, running, short, written

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
PIECE, CHUNK = 1 << 20, 8 << 20
BROADCAST_IDS = 2_000_000
BUCKET_BYTES = 128 << 20
LAST_ID = (1 << 63) - 1
#: Kinds of rows between steps: a settled run, an open one, packed suffixes or windows, packed settled runs.
SETTLED, OPEN, PACKED, RUNS = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15 | 5
_U = np.uint64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sets of random 64-bit values of bytes, and powers of the base and of its inverse modulo 2^64."""
    n = 2 * PIECE + LENGTH
    values = np.random.default_rng(20240229).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)

    def powers(b: int) -> np.ndarray:
        out = np.full(n, _U(b % (1 << 64)))
        out[0] = _U(1)
        return np.multiply.accumulate(out)

    return values, powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _prefixes(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which _hashes() takes the hash of any part; ``which`` names one of two sets of byte values."""
    values, _, inverse = _tables()
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[which][raw] * inverse[: len(raw)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each raw[start:end], a function of those bytes alone."""
    return _mixed((prefix[end] - prefix[start]) * _tables()[1][start])


def suffixes(raw: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """lead, gram, context, position, first and last window start of the suffixes that windows mark.

    valid: which window starts count (a window must not run over a document's end).
    """
    n = len(raw) - LENGTH + 1
    prefix = _prefixes(raw)
    grams = np.arange(len(raw) - GRAM + 1)
    h = (_hashes(prefix, grams, grams + GRAM) & _U(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    padded = np.full(-(-len(h) // SPAN) * SPAN, _U(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = h
    padded = padded.reshape(-1, SPAN)
    onward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    so_far = np.minimum.accumulate(padded, axis=1).ravel()
    least = np.minimum(onward[:n], so_far[SPAN - 1 : SPAN - 1 + n])
    starts = np.flatnonzero(valid[:n])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at = (least[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.concatenate([[0], new])], starts[np.concatenate([new - 1, [len(starts) - 1]])]
    at = at[np.concatenate([[0], new])]
    lead = np.zeros(len(at), np.uint64)
    for i in range(8):
        lead = (lead << _U(8)) | raw[at + i].astype(np.uint64)
    context = _hashes(prefix, first, last + LENGTH) ^ _mixed((at - first).astype(np.uint64) + _U(1))
    return lead, _hashes(prefix, at, at + GRAM), context, at, first, last


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order by the first word; only where it ties, by the next: multikey quicksort, a word at a time."""
    order = np.argsort(words[0], kind="quicksort")
    run = np.zeros(len(order), np.int64)
    for k, word in enumerate(words):
        if k:
            tied = np.zeros(len(order), bool)
            same = run[1:] == run[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            where = np.flatnonzero(tied)
            if not len(where):
                break
            sub = np.lexsort((word[order[where]], run[where]))
            order[where] = order[where][sub]
        sorted_word = word[order]
        change = sorted_word[1:] != sorted_word[:-1]
        if k:
            change |= run[1:] != run[:-1]
        run = np.concatenate([[0], np.cumsum(change)])
    return order


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Suffix columns (with document) of some CHUNK bytes of text at a time, alike ones merged; and the settled rest."""
    held: list[tuple[np.ndarray, ...]] = []
    docs: list[int] = []
    buffer: list[bytes] = []
    filled = taken = 0

    def work(texts: list[bytes], keys: list[int], offsets: list[int]) -> None:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        valid = np.ones(len(raw), bool)
        for e, n in zip(ends, lengths, strict=True):
            valid[max(e - n, e - LENGTH + 1) : e] = False
        if len(raw) < LENGTH:
            return
        lead, gram, context, at, first, last = suffixes(raw, valid)
        if not len(at):
            return
        owner = np.searchsorted(ends, at, side="right")
        shift = np.array(offsets)[owner] - (ends - lengths)[owner]
        held.append((lead, gram, context, np.array(keys)[owner], at + shift, first + shift, last + shift))

    offsets: list[int] = []
    for batch in batches:
        for key, text in rows_of(batch, "key", "text"):
            data = (text or "").encode()
            for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
                part = data[at : at + PIECE + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                buffer.append(part)
                docs.append(key)
                offsets.append(at)
                filled += len(part)
                if filled >= PIECE // 2:
                    work(buffer, docs, offsets)
                    taken += filled
                    buffer, docs, offsets, filled = [], [], [], 0
                if taken >= CHUNK and held:
                    yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    held.clear()
                    taken = 0
    if buffer:
        work(buffer, docs, offsets)
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte, which compresses better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


#: Bytes kept of lead, gram, context, key, first start, windows after it, offset of the suffix in it.
WIDTHS = (8, 6, 8, 8, 5, 1, 1)
#: Bytes kept of a window: two hashes, key, start.
WINDOW_WIDTHS = (8, 4, 8, 5)
#: Bytes kept of a settled run: key, first start, windows after it.
RUN_WIDTHS = (8, 5, 1)


def _packed(columns: tuple[np.ndarray, ...], widths: tuple[int, ...]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(c, w) for c, w in zip(columns, widths, strict=True)))


def _unpacked(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    import zstandard

    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n, at, out = len(data) // sum(widths), 0, []
    for w in widths:
        out.append(_from_planes(data[at : at + n * w], n, w))
        at += n * w
    return out


def _key_words(lead, gram, context) -> list[np.ndarray]:
    return [lead, gram & _U((1 << 48) - 1), context]


_WORDS = np.dtype([("lead", "u8"), ("gram", "u8"), ("context", "u8")])


def _bucket_of(words: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """Number of cuts at or below each suffix; all three words are looked at only where a cut has the same lead."""
    lo, hi = (np.searchsorted(cuts["lead"], words[0], side=s) for s in ("left", "right"))
    shared = np.flatnonzero(lo != hi)
    if len(shared):
        own = np.empty(len(shared), _WORDS)
        own["lead"], own["gram"], own["context"] = (w[shared] for w in words)
        lo[shared] = np.searchsorted(cuts, own, side="right")
    return lo


def _splitters(docs: DataFrame, buckets: int, n_docs: int, sample_docs: int = 400) -> np.ndarray:
    """Quantiles of the suffixes of some sample_docs documents, chosen by a hash of the key."""
    sample_docs = max(sample_docs, buckets // 8)
    some = docs.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(max(1, n_docs // sample_docs))) == 0)

    def run(batches):
        for lead, gram, context, *_ in _chunks(batches):
            words = _key_words(lead, gram, context)
            pick = np.linspace(0, len(lead) - 1, min(len(lead), 4000)).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array(w[pick].astype(np.int64)) for w in words], names=["lead", "gram", "context"])

    # Bounded: sample_docs documents in expectation, 4000 suffixes of each chunk; beyond `most` those of least context hash.
    most = max(200_000, 5 * buckets)
    found = some.mapInArrow(run, "lead bigint, gram bigint, context bigint").orderBy("context", "gram", "lead").limit(most).toPandas()
    own = np.empty(len(found), _WORDS)
    for name in ("lead", "gram", "context"):
        own[name] = found[name].to_numpy().astype(np.uint64)
    own.sort()
    return np.unique(own[np.linspace(0, len(own) - 1, buckets + 1).astype(int)[1:-1]]) if len(own) else own


def _later(new: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Which rows of sorted groups (new marks their firsts) lie at another place than their group's first.

    Rows that repeat an id and its text list the same places twice; those are no repeats.
    """
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.logical_or.reduce([p != p[first] for p in places])


def _merged(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Order of the suffixes; which of them start a gram, which start a context, which repeat an earlier one's."""
    lead, gram, context, key, at = columns
    order = multikey_order([lead, gram, context, key, at])
    a, b, c = lead[order], gram[order], context[order]
    new_gram = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    new = new_gram | np.concatenate([[True], c[1:] != c[:-1]])
    return order, new_gram, new, _later(new, key[order], at[order])


def _repeat_rows(kind: int, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(key), -1, np.int32)), pa.array(np.full(len(key), kind, np.int8)), pa.array(key.astype(np.int64)), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)), pa.nulls(len(key), pa.binary())],
        names=["bucket", "kind", "key", "first", "last", "blob"],
    )


def _packed_row(bucket: int, blob: bytes, kind: int = PACKED) -> pa.RecordBatch:
    empty = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int8()), empty, empty, empty, pa.array([blob], pa.binary())], names=["bucket", "kind", "key", "first", "last", "blob"])


def _neighbours(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as runs of neighbours in one document: key, first start, windows after it (at most 255, as runs are packed)."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(start) != 1)])
    place = np.arange(len(key))
    new |= (place - np.flatnonzero(new)[np.cumsum(new) - 1]) % 256 == 0
    heads = np.flatnonzero(new)
    return key[heads], start[heads], np.diff(np.append(heads, len(key))) - 1


def _settled_row(key: np.ndarray, first: np.ndarray, after: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Settled runs, packed, in any bucket."""
    spot = int(_mixed(key[:1].astype(np.uint64))[0] % _U(buckets))
    return _packed_row(spot, _packed((key.astype(np.uint64), first, after), RUN_WIDTHS), RUNS)


_DDL = "bucket int, kind byte, key bigint, first bigint, last bigint, blob binary"


def _listed(docs: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Step 1: packed suffixes by bucket, and the runs settled within a chunk, packed too, in any bucket."""

    def run(batches):
        for lead, gram, context, key, at, first, last in _chunks(batches):
            words = _key_words(lead, gram, context)
            order, _, new, later = _merged((*words, key, at))
            rest = order[later]
            if len(rest):
                rest = rest[np.lexsort((first[rest], key[rest]))]
                yield _settled_row(key[rest], first[rest], last[rest] - first[rest], len(cuts) + 1)
            order = order[new]
            bucket = _bucket_of([w[order] for w in words], cuts)
            for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1):
                own = order[part]
                columns = (lead[own], gram[own], context[own], key[own].astype(np.uint64), first[own], last[own] - first[own], at[own] - first[own])
                yield _packed_row(int(bucket[part[0]]), _packed(columns, WIDTHS))

    return docs.select("key", "text").mapInArrow(run, _DDL)


def _by_bucket(listed: DataFrame, parts: int, work) -> DataFrame:
    """work(bucket, blobs) over the packed suffixes or windows of each bucket, in one shuffle; packed runs are unpacked."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for (blob,) in rows_of(batch.filter(pc.equal(batch.column(1), RUNS)), "blob"):
                key, first, after = (c.astype(np.int64) for c in _unpacked(blob, RUN_WIDTHS))
                yield _repeat_rows(SETTLED, key, first, first + after)
            for bucket, blob in rows_of(batch.filter(pc.equal(batch.column(1), PACKED)), "bucket", "blob"):
                if bucket != now and held:
                    yield from work(now, held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from work(now, held)

    return listed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _DDL)


def _compared(cuts: np.ndarray):
    """Step 2: settled and open suffixes of a bucket."""

    def work(bucket: int, blobs: list[bytes]):
        columns = [np.concatenate(c) for c in zip(*(_unpacked(b, WIDTHS) for b in blobs), strict=True)]
        lead, gram, context, key, first, after, offset = columns
        key, first = key.astype(np.int64), first.astype(np.int64)
        last = first + after.astype(np.int64)
        order, new_gram, new, later = _merged((lead, gram, context, key, first + offset.astype(np.int64)))
        contexts = np.bincount(np.cumsum(new_gram) - 1, weights=new)
        open_gram = contexts > 1
        a, b = lead[order][new_gram], gram[order][new_gram]
        for cut in cuts[max(0, bucket - 1) : bucket + 1]:  # the gram may go on beyond the bucket
            open_gram |= (a == cut["lead"]) & (b == cut["gram"])
        rest, asked = order[later], order[new & open_gram[np.cumsum(new_gram) - 1]]
        for kind, own in ((SETTLED, rest), (OPEN, asked)):
            if len(own):
                yield _repeat_rows(kind, key[own], first[own], last[own])

    return work


def _windows(asked: DataFrame, buckets: int) -> DataFrame:
    """Step 3, first half: hashes of the open windows, equal ones of a chunk once, packed by bucket of the hash."""

    def run(batches):
        held, n = [], 0

        def blobs():
            own, again = _told_apart(*(np.concatenate(c) for c in zip(*held, strict=True)))
            if len(again[0]):
                yield _settled_row(*_neighbours(*again), buckets)
            bucket = ((own[0] >> _U(40)) * _U(buckets)) >> _U(24)
            for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                yield _packed_row(int(bucket[part[0]]), _packed(tuple(c[part] for c in own), WINDOW_WIDTHS))

        for batch in short(batches):
            for key, text, runs in rows_of(batch, "key", "text", "runs"):
                raw = np.frombuffer(text.encode(), np.uint8)
                s = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs]))
                for at in range(0, len(raw), PIECE):
                    own = s[(s >= at) & (s < at + PIECE)] - at
                    if len(own):
                        part = raw[at : at + PIECE + LENGTH]
                        two = [_hashes(_prefixes(part, k), own, own + LENGTH) for k in range(2)]
                        held.append((two[0], two[1] & _U(0xFFFFFFFF), np.full(len(own), key, np.uint64), (own + at).astype(np.uint64)))
                        n += len(own)
                if n >= 1_000_000:
                    yield from blobs()
                    held, n = [], 0
        if n:
            yield from blobs()

    return asked.mapInArrow(run, _DDL)


def _told_apart(*columns: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """Of windows (two hashes, key, start): the first of each equal ones, by hash; key and start of those that repeat it."""
    order = multikey_order(list(columns))
    h, other, key, start = (c[order] for c in columns)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])])
    again = _later(new, key, start)
    return (h[new], other[new], key[new], start[new]), (key[again], start[again])


def _repeated(bucket: int, blobs: list[bytes]):
    """Step 3, second half: all but the first of equal windows."""
    columns = [np.concatenate(c) for c in zip(*(_unpacked(b, WINDOW_WIDTHS) for b in blobs), strict=True)]
    _, (key, start) = _told_apart(*columns)
    if len(key):
        key, first, after = _neighbours(key.astype(np.int64), start.astype(np.int64))
        yield _repeat_rows(SETTLED, key, first, first + after)


def _texts_of(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs joined with lists(list_key, ...); the scan is filtered first by a broadcast of the keys while they are few."""
    if lists.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(lists.select("list_key")), F.col("key") == F.col("list_key"), "left_semi")
    return docs.join(lists, F.col("key") == F.col("list_key")).drop("list_key")


def _spans(runs: np.ndarray, n: int) -> np.ndarray:
    """Merged byte spans (start, end) of windows runs (first, last)."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(runs[:, 1] + LENGTH)
    new = np.concatenate([[True], runs[1:, 0] > ends[:-1]])
    heads = np.flatnonzero(new)
    return np.stack([runs[heads, 0], np.minimum(ends[np.concatenate([heads[1:] - 1, [len(runs) - 1]])], n)], axis=1)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text adds ``kept``, the bytes that stay."""
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("least", F.coalesce("doc_id", F.lit(LAST_ID)))
    rows = materialise(base.select("doc_id", "least", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-rows")
    distinct = rows.select("least", "sha", "n_bytes").distinct()
    counts = distinct.agg(F.count("*").alias("n"), F.countDistinct("least").alias("ids"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    if counts.n == counts.ids:
        docs, keyed = base.select(F.col("least").alias("key"), "text"), rows.withColumn("key", F.col("least"))
    else:
        ranks = materialise(running(distinct, ["least", "sha"], {}, "suffix-ranks").withColumnRenamed("nth", "key"), "suffix-keys").select(F.col("least").alias("l"), F.col("sha").alias("s"), "key")
        docs = base.join(ranks, (F.col("least") == F.col("l")) & (F.sha2("text", 256) == F.col("s"))).select("key", "text")
        docs = materialise(docs, "suffix-docs")
        keyed = rows.join(ranks, (F.col("least") == F.col("l")) & (F.col("sha") == F.col("s"))).drop("l", "s")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(3 * parts, -(-counts.bytes // BUCKET_BYTES))
    cuts, since = _splitters(docs, buckets, counts.n), written()
    compared = materialise(_by_bucket(_listed(docs, cuts), parts, _compared(cuts)), "suffix-compared")
    asked = compared.where(F.col("kind") == OPEN).groupBy(F.col("key").alias("list_key")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    windows = _windows(_texts_of(docs, materialise(asked, "suffix-asked")).select("key", "text", "runs"), buckets)
    again = materialise(_by_bucket(windows, parts, _repeated), "suffix-windows")
    settled = [x.where(F.col("kind") == SETTLED).select("key", "first", "last") for x in (compared, again)]
    runs = settled[0].unionAll(settled[1]).groupBy(F.col("key").alias("list_key")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = materialise(runs, "suffix-runs")
    release(spark, since, (runs,))

    def cut(batches):
        for batch in short(batches):
            out = [[] for _ in range(5)]
            for key, text, found in rows_of(batch, "key", "text", "runs"):
                data = text.encode()
                spans = _spans(np.array([(r["first"], r["last"]) for r in found], np.int64), len(data))
                edges = [0, *spans.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(out, (key, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["cut_key", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = _texts_of(docs, runs).select("key", "text", "runs").mapInArrow(cut, "cut_key bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").dropDuplicates(["cut_key"])
    out = keyed.join(done, F.col("key") == F.col("cut_key"), "left")
    out = out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept"] if with_text else []))
    return out
