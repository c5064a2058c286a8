"""LM scoring: a weighted backoff automaton of smoothed n-grams, counted over all training documents.

The model: tokens are lower-cased words and one end for each document; a document starts in the context ``start``.
Words: (c - d) / N of the training tokens, the rest, d V / N, for a word never seen, where d = n1 / (n1 + 2 n2) of
the words seen once and twice. Longer n-grams: p(w | h) = (c(hw) + s p(w | h')) / (c(h) + s), h' being h without its first
word and s the strength. As an automaton: contexts that were seen are states; an n-gram that was seen is an arc with its
probability; every other word takes the failure arc to h', which weighs s / (c(h) + s). One walk from left to right over a
document carries the state and adds the logarithms.

The whole automaton grows with the corpus and is never put together. Documents are packed into chunks of a few megabytes;
each chunk asks, for its distinct n-grams, how often they occur elsewhere. The requests are dealt out by the n-gram's hash
to buckets, whose number follows from the input's size; a bucket adds up what the chunks counted and answers each. So
each chunk gets exactly the states and arcs that its own documents can reach, and walks them. A frequent n-gram is one
request a chunk.

Defined results: null text is empty, with the end as its only token; a null id is the text '' when folds are dealt; rows
that are repeated are learnt from and scored each; without training documents every word has probability 1 in either
score; an empty table gives an empty result; other columns are dropped, so clashing names do no harm. N-grams are told
apart by 64 bits: of a thousand million distinct words, fewer than one pair is expected to be taken for one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lensmill.llm.common import materialise, rows_of, short, to_batch

#: Words of an n-gram at most, and how many observations the shorter context counts for.
ORDER, STRENGTH = 2, 500.0
#: Bytes of text of a chunk (one longer document is a chunk of its own), and of all texts for each bucket.
CHUNK, BUCKET = 8 << 20, 8 << 20
#: No word has white space in it, so these are none.
START, END = b"\n<", b"\n>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What of a stored chunk its n-grams are made from.
CHUNK_COLUMNS = ("n_words", "size", "words", "places", "lengths", "folds")
_REPLY = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("level", pa.int32()), ("size", pa.int64()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def unpacked(data: bytes, size: int, kind: type) -> np.ndarray:
    if not size:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which compress better."""
    return np.diff(keys, prepend=np.uint64(0))


class Grams:
    """The n-grams of a chunk up to an order. For each level: at (the number of the n-gram that ends at a place, in order of
    their hashes, -1 for none), keys (the hashes), own (training occurrences), first (a place of each)."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, lengths: np.ndarray, trained: np.ndarray, order: int):
        """ids: places in words (hashes, ascending) of each document's start, words and end, one document after the other."""
        taught = np.repeat(trained, lengths)
        offset = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.levels = [(ids, words, np.bincount(ids[taught], minlength=len(words)), None)]
        for k in range(2, order + 1):
            shorter, hashes, _, _ = self.levels[-1]
            places = np.flatnonzero(offset >= k - 1)
            pairs = shorter[places - 1] * len(words) + ids[places]
            by = np.argsort(pairs, kind="stable")
            fresh = np.diff(pairs[by], prepend=-1) != 0
            first = places[by[fresh]]
            key = (hashes[shorter[first - 1]] ^ (hashes[shorter[first - 1]] >> np.uint64(29))) * _MIX + words[ids[first]]
            key ^= key >> np.uint64(32)
            ranks = np.argsort(key, kind="stable")
            renamed = np.empty(len(ranks), np.int64)
            renamed[ranks] = np.arange(len(ranks))
            at = np.full(len(ids), -1, np.int64)
            at[places[by]] = renamed[np.cumsum(fresh) - 1]
            self.levels.append((at, key[ranks], np.bincount(at[places][taught[places]], minlength=len(ranks)), first[ranks]))


def _chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, words, lengths of some lower-cased texts, as Grams takes them."""
    import xxhash

    tokens, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split()
        lengths[i] = len(own) + 2
        tokens.append(START)
        tokens += own
        tokens.append(END)
    distinct = dict.fromkeys(tokens)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    words, place = np.unique(hashes, return_inverse=True)
    for w, p in zip(distinct, place.tolist(), strict=True):
        distinct[w] = p
    return np.fromiter(map(distinct.__getitem__, tokens), np.int64, len(tokens)), words, lengths


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """A row for each chunk: its words (hashes, ascending) and, for each of its documents, id, fold, length and places in words."""
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("size", pa.int64()), *[(n, pa.binary()) for n in ("words", "places", "lengths")], ("doc_ids", pa.list_(to_arrow_type(id_type))), ("folds", pa.list_(pa.bool_()))])

    def close(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, words, lengths = _chunk([t for _, _, t in held])
        row = (number, len(words), len(ids), packed(steps(words)), packed(ids.astype(np.uint32)), packed(lengths.astype(np.uint32)), [i for i, _, _ in held], [out for _, out, _ in held])
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in short(batches):
            for doc_id, out, text in rows_of(batch, "doc_id", "held_out", "text"):
                if held and size + len(text) > chunk_bytes:
                    yield close(number, held)
                    number, held, size = number + 1, [], 0
                held.append((doc_id, out, text.lower()))
                size += len(text)
        if held:
            yield close(number, held)

    own = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(pack, f"chunk bigint, n_words bigint, size bigint, words binary, places binary, lengths binary, doc_ids array<{id_type.simpleString()}>, folds array<boolean>")


def grams_of(row: tuple, order: int) -> tuple[Grams, np.ndarray]:
    """The n-grams of a stored chunk (n_words, size, words, places, lengths, folds) and the lengths of its documents."""
    n_words, size, words, places, lengths, folds = row
    lengths = unpacked(lengths, len(folds), np.uint32).astype(np.int64)
    ids = unpacked(places, size, np.uint32).astype(np.int64)
    return Grams(ids, np.cumsum(unpacked(words, n_words, np.uint64), dtype=np.uint64), lengths, ~np.array(folds, bool), order), lengths


def requests(stored: DataFrame, buckets: int, order: int) -> DataFrame:
    """For each chunk, bucket and level, the n-grams of the chunk that fall into the bucket, and their own training counts."""
    span = (1 << 64) // buckets + 1
    cuts = np.array([b * span for b in range(1, buckets)], np.uint64)
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("level", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *row in rows_of(batch, "chunk", *CHUNK_COLUMNS):
                for level, (_, keys, own, _) in enumerate(grams_of(row, order)[0].levels, 1):
                    at = np.searchsorted(keys, cuts).tolist()
                    rows = [(number, bucket, level, b - a, packed(steps(keys[a:b])), packed(own[a:b].astype(np.uint32))) for bucket, (a, b) in enumerate(zip([0, *at], [*at, len(keys)], strict=True)) if a < b]
                    yield to_batch(schema, zip(*rows, strict=True))

    return stored.select("chunk", *CHUNK_COLUMNS).mapInArrow(ask, "chunk bigint, bucket bigint, level int, size bigint, keys binary, counts binary")


def held_out(name: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 2 by 7."""
    return (F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 7) == 2


def answers(asked: DataFrame) -> DataFrame:
    """For each request, how often its n-grams occur in other chunks (kind 1), and for each bucket's words: types, tokens, types
    seen once and twice (kind 2)."""
    import xxhash

    start = np.uint64(xxhash.xxh64_intdigest(START))

    def add(group: list[tuple]) -> Iterator[tuple]:
        bucket, level = group[0][:2]
        sizes = [g[3] for g in group]
        keys = np.concatenate([np.cumsum(unpacked(g[4], g[3], np.uint64), dtype=np.uint64) for g in group])
        own = np.concatenate([unpacked(g[5], g[3], np.uint32) for g in group]).astype(np.int64)
        by = np.argsort(keys, kind="stable")
        ordered = keys[by]
        fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(own[by], fresh)
        others = np.empty(len(keys), np.int64)
        others[by] = np.repeat(sums, np.diff(np.append(fresh, len(keys))))
        others -= own
        for g, part in zip(group, np.split(others, np.cumsum(sizes)[:-1]), strict=True):
            yield 1, g[2], bucket, level, g[3], packed(part) if part.any() else b"", None
        if level == 1:
            seen = sums[ordered[fresh] != start]
            yield 2, -1, bucket, level, 0, None, [int((seen > 0).sum()), int(seen.sum()), int((seen == 1).sum()), int((seen == 2).sum())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        for batch in batches:
            for row in rows_of(batch, "bucket", "level", "chunk", "size", "keys", "counts"):
                if group and group[0][:2] != row[:2]:
                    yield to_batch(_REPLY, zip(*add(group), strict=True))
                    group.clear()
                group.append(row)
        if group:
            yield to_batch(_REPLY, zip(*add(group), strict=True))

    own = asked.repartition("bucket").sortWithinPartitions("bucket", "level", "chunk")
    return own.mapInArrow(run, "kind int, chunk bigint, bucket bigint, level int, size bigint, counts binary, stats array<bigint>")


class Automaton:
    """The states and arcs that a chunk's documents can reach.

    A state is a context, an n-gram below the order that was seen (level 0: the empty one). An arc is an n-gram that was seen: it
    leaves its context by its last word, weighs the logarithm of its probability and goes to the longest context that it
    ends with. Both have the numbers that Grams gave the n-grams; weights: of arcs by level, NaN for none; fails: of the
    failure arcs by level.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], types: int, tokens: int, once: int, twice: int, strength: float):
        d = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))
        known = counts[0] > 0
        p = np.where(known, counts[0] - d, d * types) / tokens if tokens else np.ones(len(known))
        self.order, self.places = len(counts), [None, *[level[0] for level in grams.levels]]
        self.known, self.weights, self.fails = known.tolist(), [None, np.log10(p).tolist()], [None]
        for k in range(1, self.order):
            self.fails.append(np.log10(strength / (counts[k - 1] + strength)).tolist())
            first = grams.levels[k][3]
            shorter, seen = grams.levels[k - 1][0], np.flatnonzero(counts[k])
            longer = np.full(len(counts[k]), np.nan)
            place = first[seen]
            longer[seen] = (counts[k][seen] + strength * p[shorter[place]]) / (counts[k - 1][shorter[place - 1]] + strength)
            self.weights.append(np.log10(longer).tolist())
            p = longer

    def walk(self, a: int, b: int) -> float:
        """The log10 probability of the document at places a (its start) to b (after its end), from left to right."""
        at = [None, *[x[a:b].tolist() for x in self.places[1:]]]
        weights, fails, known, top = self.weights, self.fails, self.known, self.order - 1
        words, root, terms = at[1], weights[1], []
        # The state is the context of this level that ends before the next word.
        level = 1 if top and known[words[0]] else 0
        for i in range(1, b - a):
            while level:
                arc = at[level + 1][i]
                if arc >= 0 and (weight := weights[level + 1][arc]) == weight:
                    terms.append(weight)
                    level = min(level + 1, top)
                    break
                terms.append(fails[level][at[level][i - 1]])
                level -= 1
            else:
                word = words[i]
                terms.append(root[word])
                level = 1 if top and known[word] else 0
        return math.fsum(terms)


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stored = materialise(chunks(docs, chunk_bytes), "chunks")
    replies = materialise(answers(requests(stored, max(1, -(-size // bucket_bytes)), order)), "answers")
    totals = replies.where("kind = 2").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4)]).first()
    types, tokens, once, twice = map(int, totals)
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("held_out", pa.bool_()), *[(n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])

    def close(chunk: tuple, parts: list[tuple]) -> pa.RecordBatch:
        *row, doc_ids = chunk
        grams, lengths = grams_of(row, order)
        counts = []
        for level in range(1, order + 1):
            others = [unpacked(data, size, np.int64) if data else np.zeros(size, np.int64) for at, size, data in parts if at == level]
            counts.append(grams.levels[level - 1][2] + (np.concatenate(others) if others else 0))
        automaton = Automaton(grams, counts, types, tokens, once, twice, strength)
        base = np.log10((counts[0] + 1) / (tokens + types + 1))
        ids, out, end = grams.levels[0][0], [], 0
        for doc_id, fold, length in zip(doc_ids, row[-1], lengths.tolist(), strict=True):
            start, end = end, end + length
            told = ids[start + 1 : end]
            out.append((doc_id, fold, length - 1, int((counts[0][told] > 0).sum()), tokens, math.fsum(base[told].tolist()), automaton.walk(start, end)))
        return to_batch(schema, zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts = None, []
        for batch in batches:
            for kind, level, n, counts, *row in rows_of(batch, "kind", "level", "size", "counts", *CHUNK_COLUMNS, "doc_ids"):
                if kind == 0:
                    if chunk:
                        yield close(chunk, parts)
                    chunk, parts = tuple(row), []
                else:
                    parts.append((level, n, counts))
        if chunk:
            yield close(chunk, parts)

    whole = stored.withColumn("kind", F.lit(0)).unionByName(replies.where("kind = 1").drop("stats"), allowMissingColumns=True)
    whole = whole.repartition("chunk").sortWithinPartitions("chunk", "kind", "level", "bucket")
    return whole.mapInArrow(run, f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
