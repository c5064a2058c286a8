"""SimHash near-duplicates, searched by generalised pigeonhole.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words with repeats (fewer words: the
whole sequence), XXH64 with seed 42 of the UTF-8; a bit is 1 if it is set in over half the hashes.

Search for pairs within ``tau`` bits among the distinct fingerprints: bits that correlate go to the same partition;
thresholds t_i >= -1 with sum(t_i) = tau - parts + 1 guarantee that each pair within tau agrees within t_i bits on some
partition i; dynamic programming picks those thresholds at the least estimated number of candidates. A row is filed
under its own value of each partition, and under each value within t_i bits (probes). Rows that meet in a bucket are
verified by exact distance. A bucket is verified in blocks, and each block returns a forest of its links instead of
all its pairs: it is walked breadth first, so a group of near copies costs neither quadratic output nor quadratic work
in a block. Buckets beyond one block are dealt out as pairs of blocks, so none is capped. Components come from forests
of chunks of the links and large-star/small-star rounds over them.

near_duplicates() serves corpora: documents are near copies if the sets of their five-word shingles have a Jaccard
likeness of LIKENESS or more. Its 256-bit fingerprints are taken over those sets (repeats count once), the hashes being
mixed into three more words. A pair at 0.8 differs in 39 bits on average, and in some 48 if the sets are tiny; a
pigeonhole over that many of 256 bits has no selective partitions. So candidates come from NEAR_PARTS partitions of 32
bits, which stay selective for billions of rows and guarantee NEAR_TAU bits, and beyond them from BANDS buckets of
BAND_ROWS least hashes of the set each: a pair of likeness j meets in one of those with
1 - (1 - j ** BAND_ROWS) ** BANDS, 0.99996 at 0.8. Candidates within NEAR_BITS are put in groups, and within each group
the sets themselves are compared: only links of LIKENESS or more count.

Defined results: null text is empty, its fingerprint is 0 and links like any other; equal texts share a fingerprint;
null ids take no part in a component's smallest id (a component of null ids only has a null id); repeated rows keep
one result row each; an empty table gives an empty result; other columns are dropped, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import materialise, numbered, rows_of, short, to_batch
from lensmill.llm.components import forest, smallest_reachable, with_least

WIDE, NEAR_TAU, NEAR_PARTS, NEAR_BITS = 4, 7, (8,), 72
LIKENESS, NEAR_WORDS = 0.8, 5
BANDS, BAND_ROWS = 14, 3
#: Rows, and shingles, of a group that are held by a block when sets are compared.
SET_ROWS, SET_SHINGLES = 8192, 2_000_000
#: What filing a row in a bucket costs, in comparisons of two fingerprints.
FILING = 300
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints of a bucket that a block holds.
BLOCK = 8192


def _bits(hashes: np.ndarray) -> int:
    """Majority of the hashes' bits, bit 63 of a hash first; hashes is n x words."""
    total = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    import xxhash

    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-width]]]
    return np.array([hashed(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64)


def fingerprint(text: str) -> int:
    words = text.encode().translate(_LOWER).split()
    return _bits(_shingle_hashes(words, 3)[:, None]) if words else 0


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes of the five-word shingles, ascending; empty without words."""
    words = text.encode().translate(_LOWER).split()
    return np.unique(_shingle_hashes(words, NEAR_WORDS)) if words else np.empty(0, np.uint64)


def set_node(own: np.ndarray) -> int:
    """What stands for a set: equal sets are alike 1."""
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 42)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(own: np.ndarray) -> tuple[int, ...]:
    """WIDE words of a shingle set: the majority of its hashes, and of those mixed from them."""
    if not len(own):
        return (0,) * WIDE
    bits = _bits(np.stack([own, *[_mixed(own, k) for k in range(1, WIDE)]], axis=1))
    return tuple(bits >> (64 * k) & ((1 << 64) - 1) for k in reversed(range(WIDE)))


def bands_of(own: np.ndarray) -> list[int]:
    """A hash of each band's BAND_ROWS least hashes, each under a mixing of its own; an empty set has its own."""
    if not len(own):
        return [0] * BANDS
    least = np.array([_mixed(own, WIDE + k).min() for k in range(BANDS * BAND_ROWS)], np.uint64).reshape(BANDS, BAND_ROWS)
    key = np.zeros(BANDS, np.uint64)
    for k in range(BAND_ROWS):
        key = _mixed(key ^ least[:, k], k + 1)
    return key.astype(np.int64).tolist()


def prints_of(wide: bool) -> list[str]:
    return ["fp", *[f"w{k}" for k in range(1, WIDE if wide else 1)]]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            ids, found = [], []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                ids.append(doc_id)
                found.append(fingerprint(text or ""))
            yield to_batch(schema, [ids, np.array(found, np.uint64).astype(np.int64)])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _texts(df: DataFrame, id_col: str, text_col: str, row_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row_col).alias("row_at"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def set_fingerprints(texts: DataFrame) -> DataFrame:
    """doc_id, row_at, node, n_shingles, the prints and bands of every row of _texts(); no shuffle."""
    names = ["node", "n_shingles", *prints_of(True)]
    schema = pa.schema([*[(n, pa.int64()) for n in ["doc_id", "row_at", *names]], ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            given, found, bands = [], [], []
            for *row, text in rows_of(batch, "doc_id", "row_at", "text"):
                own = shingle_set(text)
                given.append(row)
                found.append((set_node(own), len(own), *wide_fingerprint(own)))
                bands.append(bands_of(own))
            values = np.array(found, np.uint64).reshape(-1, len(names)).astype(np.int64)
            yield to_batch(schema, [*([r[k] for r in given] for k in range(2)), *values.T, bands])

    return texts.mapInArrow(run, ", ".join(f"{n} bigint" for n in schema.names[:-1]) + ", bands array<bigint>")


def bit_statistics(distinct: DataFrame, prints: list[str]) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the co-occurrence of their bits, over all rows; each task sends one matrix."""
    width = 64 * len(prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                v = np.stack([c.slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
                bits = np.unpackbits(v.astype(">i8").view(np.uint8).reshape(len(v), -1), axis=1).astype(np.float32)
                total += bits.T @ bits
                n += len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, n, np.int64)), pa.array(np.arange(width, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["n", "r", "m"])

    parts = distinct.select(*prints).mapInArrow(run, "n bigint, r int, m array<double>")
    rows = parts.select("n", "r", F.posexplode("m").alias("k", "v")).groupBy("r", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    out = np.zeros((width, width))
    if len(rows):
        out[rows.r.to_numpy(), rows.k.to_numpy()] = rows.v.to_numpy()
    return (int(rows.n.iloc[0]) if len(rows) else 0), out


def partition_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 = highest of the first word) grouped so that each group takes, turn by turn, the bit that correlates most with it."""
    width = len(together)
    if n < 2:
        return [list(map(int, x)) for x in np.array_split(np.arange(width), parts)]
    mean = together.diagonal() / n
    cov = together / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(cov.diagonal(), 1e-9))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, groups = np.ones(width, bool), []
    for g in range(parts):
        quota = int(left.sum()) // (parts - g)
        own = [int(np.where(left, corr[:, left].sum(axis=1), -1).argmax())]
        left[own[0]] = False
        tied = corr[own[0]].copy()
        while len(own) < quota:
            nxt = int(np.where(left, tied, -1).argmax())
            own.append(nxt)
            left[nxt] = False
            tied += corr[nxt]
        groups.append(sorted(own))
    return groups


def key_of(bits: list[int], prints: list[str]):
    """A column expression: the partition's bits, packed."""
    runs: list[tuple[int, int, int]] = []
    for k, b in enumerate(bits):
        if runs and runs[-1][0] + runs[-1][1] == b and b % 64:
            runs[-1] = (runs[-1][0], runs[-1][1] + 1, runs[-1][2])
        else:
            runs.append((b, 1, k))
    parts = [f"shiftleft(shiftrightunsigned({prints[b // 64]}, {64 - b % 64 - n}) & {(1 << n) - 1}L, {len(bits) - k - n})" for b, n, k in runs]
    return F.expr(" | ".join(parts))


def allocate(costs: list[list[float]], tau: int) -> list[int]:
    """Thresholds t_i in -1..tau with sum tau - parts + 1 at the least total cost; costs[i][t + 1], cost of -1 first."""
    want = tau - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in enumerate(own, start=-1):
                if total + t not in step or step[total + t][0] > cost + c:
                    step[total + t] = (cost + c, [*chosen, t])
        best = step
    return best[want][1]


def plan(distinct: DataFrame, tau: int, options: tuple[int, ...]) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed; the estimates come from all distinct fingerprints.

    A partition's cost at threshold 0 is its exact number of agreeing pairs; each further bit multiplies the values
    that are probed, so its pairs are estimated as those of 0 times that number of values; each filing adds its own
    cost. Of the numbers of partitions in options the cheapest is taken.
    """
    prints = [c for c in distinct.columns if c != "node"]
    n, together = bit_statistics(distinct, prints)
    groups = {parts: partition_bits(n, together, parts) for parts in options}
    listed = [(parts, i, g) for parts, own in groups.items() for i, g in enumerate(own)]
    keys = distinct.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), key_of(g, prints).alias("key")) for k, (_, _, g) in enumerate(listed)])).alias("e"))
    counted = keys.groupBy("e.k", "e.key").count()
    sums = {r.k: float(r.pairs) for r in counted.groupBy("k").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    best = None
    for parts, own_groups in groups.items():
        costs = []
        for k, (_, _, g) in enumerate(listed):
            if listed[k][0] != parts:
                continue
            own, probes = [0.0], 0
            for t in range(tau + 1):
                probes += len(list(combinations(range(len(g)), t))) if t <= 3 else 1 << 40
                own.append((sums.get(k, 0.0) + FILING * max(n, 1)) * probes)  # probes cost in an empty table too
            costs.append(own)
        thresholds = allocate(costs, tau)
        total = sum(c[t + 1] for c, t in zip(costs, thresholds, strict=True))
        if best is None or total < best[0]:
            best = (total, [(g, t) for g, t in zip(own_groups, thresholds, strict=True) if t >= 0])
    return best[1]


def filed(distinct: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """node, prints, bucket and own: each fingerprint in its own bucket (own), in those it probes and in its bands', if it has any."""
    prints, entries = [c for c in distinct.columns if c not in ("node", "bands")], []
    for i, (bits, t) in enumerate(chosen):
        key = key_of(bits, prints)
        for mask in (sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(len(bits)), k)):
            entries.append(F.struct(F.xxhash64(F.lit(i), key.bitwiseXOR(F.lit(mask).cast("long"))).alias("bucket"), F.lit(mask == 0).alias("own")))
    places = F.array(*entries)
    if "bands" in distinct.columns:
        places = F.concat(places, F.transform("bands", lambda key, k: F.struct(F.xxhash64(F.lit("band"), k, key).alias("bucket"), F.lit(True).alias("own"))))
    return distinct.select("node", *prints, F.explode(places).alias("e")).select("node", *prints, "e.bucket", "e.own")


#: Roots that reach little, one after another, before a block is compared in slabs; rows of a slab.
PATIENCE, SLAB = 8, 256


def _differing(some: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Differing bits of each of some (n x words) and each column of rest (words x m)."""
    off = np.bitwise_count(some[:, :1] ^ rest[0]).astype(np.uint16)
    for k in range(1, len(rest)):
        off += np.bitwise_count(some[:, k : k + 1] ^ rest[k])
    return off


def print_links(own: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest, as places a and b, of the pairs of prints (n x words) within limit bits, one of each pair being own.

    Walked breadth first from one own row after another: a row is compared with those not reached yet, so a group of
    near copies costs little more than one comparison a row. Where walks reach little, the rows that are left are
    compared slab by slab, each slab folded into the forest. Rows reached before are linked to none of those left.
    """
    n = len(own)
    left = np.argsort(~own, kind="stable")
    rest = np.ascontiguousarray(prints[left].T)
    homes, idle, reached = int(own.sum()), 0, 0
    a, b, queue = [], [], []
    while len(left) > 1 or (queue and len(left)):
        if queue:
            i = queue.pop()
        else:
            idle = 0 if reached > 2 else idle + 1
            if not homes or idle > PATIENCE:
                break
            i, left, rest, homes, reached = left[0], left[1:], rest[:, 1:], homes - 1, 0
        near = _differing(prints[i : i + 1], rest)[0] <= limit
        if near.any():
            hit = left[near]
            a.append(np.full(len(hit), i))
            b.append(hit)
            queue.extend(hit.tolist())
            homes -= int(own[hit].sum())
            reached += len(hit)
            left, rest = left[~near], rest[:, ~near]
    for at in range(0, homes if len(left) > 1 else 0, SLAB):
        some = left[at : min(at + SLAB, homes)]
        # Pairs of two own rows are met by the earlier one.
        i, j = np.nonzero(_differing(prints[some], rest[:, at:]) <= limit)
        found = forest(n, some[i], left[at:][j])
        a.append(found[0])
        b.append(found[1])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(n, np.concatenate(a), np.concatenate(b))


def block_links(distinct: DataFrame, tau: int, options: tuple[int, ...], limit: int) -> DataFrame:
    """a, b: a forest of the links found in each block or pair of blocks of a bucket of distinct(node, fp, ..), by at most limit bits."""
    carried = [c for c in distinct.columns if c not in ("node", "bands")]
    return met(filed(distinct, plan(distinct.select("node", *carried), tau, options)), limit)


def met(buckets: DataFrame, limit: int) -> DataFrame:
    """a, b: a forest of the links within limit bits in each block or pair of blocks of buckets(node, prints .., bucket, own)."""
    carried = [c for c in buckets.columns if c not in ("node", "bucket", "own")]
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("filed")).where((F.col("n") > 1) & F.col("filed"))
    dealt = buckets.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("x"), F.greatest(j, F.col("block")).alias("y")))
    dealt = dealt.select("bucket", "own", "node", *carried, F.explode(pairs).alias("xy")).select("bucket", "xy.x", "xy.y", "own", "node", *carried)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and block pair; a group ends where those change."""
        now, held = None, []

        def flush() -> pa.RecordBatch | None:
            own, node, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = print_links(own, prints, limit)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"]) if len(a) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = np.stack([c.astype(np.int64) for c in columns[:3]], axis=1)
            prints = np.stack([c.astype(np.uint64) for c in columns[5:]], axis=1)
            for piece in np.split(np.arange(len(keys)), np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1):
                key = tuple(keys[piece[0]])
                if key != now and held:
                    if (found := flush()) is not None:
                        yield found
                    held = []
                now = key
                held.append((columns[3][piece].astype(bool), columns[4][piece], prints[piece]))
        if held and (found := flush()) is not None:
            yield found

    grouped = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return grouped.mapInArrow(verified, "a bigint, b bigint")


def _named(rows: DataFrame, distinct: DataFrame, links: DataFrame, *kept: str) -> DataFrame:
    """rows(doc_id, node, ..) with component_id, the least id of what the links reach of distinct(node, least)."""
    reached = smallest_reachable(links).withColumnRenamed("node", "reached")
    named = distinct.join(reached, F.col("node") == F.col("reached"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    by_node = with_least(named, "root", "least", "node").select(F.col("node").alias("own_node"), F.col("m").alias("component_id"))
    return rows.join(by_node, F.col("node") == F.col("own_node")).select("doc_id", *kept, "component_id")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, options: tuple[int, ...] = (2, 3)) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable by links within tau bits) of every row."""
    rows = materialise(fingerprints(df, id_col, text_col).withColumn("node", F.col("fp")), "simhash")
    distinct = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")), "simhash-fp")
    links = materialise(block_links(distinct.select("node", "fp"), tau, options, tau).distinct(), "simhash-links")
    return _named(rows, distinct, links, "fp")


def set_links(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of sets of LIKENESS or more; hashes holds the sets one after another, sizes their lengths.

    Walked breadth first: a set is compared with those not reached yet, by the sets that hold each of its hashes. The
    lists of holders are made again whenever half of the sets in them have been reached, so that the many sets of a
    group of copies do not weigh on those that are left.
    """
    n = len(sizes)
    _, code = np.unique(hashes, return_inverse=True)
    n_codes = int(code.max()) + 1 if len(code) else 0
    owner = np.repeat(np.arange(n), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left, found_a, found_b = np.ones(n, bool), [], []
    listed = n_left = n

    def holders_of(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = code[kept]
        return owner[kept][np.argsort(some, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(some, minlength=n_codes))])

    holders, first = holders_of(np.ones(len(code), bool))
    for root in range(n):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        n_left -= 1
        while queue and n_left:
            if n_left <= listed // 2:
                holders, first = holders_of(left[owner])
                listed = n_left
            i = queue.pop()
            codes = code[starts[i] : starts[i + 1]]
            at, many = first[codes], first[codes + 1] - first[codes]
            at, many = at[many > 0], many[many > 0]
            if not len(many):
                continue
            met, both = np.unique(holders[np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())], return_counts=True)
            # both / union >= LIKENESS, in whole numbers
            alike = met[left[met] & (both * 5 >= (sizes[i] + sizes[met] - both) * 4)]
            left[alike] = False
            n_left -= len(alike)
            found_a.append(np.full(len(alike), i))
            found_b.append(alike)
            queue.extend(alike.tolist())
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def alike_links(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """a, b: a forest of the links of LIKENESS or more among each group of candidates(one_at, node, n_shingles, root).

    Sets are made again from one row's text of each candidate, so equal sets do not meet again. Groups beyond a block are dealt out as pairs of blocks, so
    none is capped.
    """
    sums = candidates.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / SET_ROWS), F.ceil(F.col("total") / SET_SHINGLES)).cast("int")
    placed = candidates.join(sums.select(F.col("root").alias("r"), blocks.alias("blocks")), F.col("root") == F.col("r"))
    placed = placed.select("one_at", "node", "root", "blocks")
    found = texts.join(placed.hint("merge"), F.col("row_at") == F.col("one_at")).select("node", "root", "blocks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            rows = [[], [], [], []]
            for node, root, n, text in rows_of(batch, "node", "root", "blocks", "text"):
                for column, value in zip(rows, (node, root, n, shingle_set(text).tobytes()), strict=True):
                    column.append(value)
            yield to_batch(schema, rows)

    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("blocks", pa.int32()), ("own", pa.binary())])
    sets = found.mapInArrow(run, "node bigint, root bigint, blocks int, own binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("x"), F.greatest(j, F.col("block")).alias("y")))
    dealt = sets.withColumn("block", block).select("root", "node", "own", F.explode(pairs).alias("xy")).select("root", "xy.x", "xy.y", "node", "own")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and block pair."""
        now, held = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            nodes = np.array(list(held), np.int64)
            own = [np.frombuffer(x, np.uint64) for x in held.values()]
            if len(own) > 1:
                a, b = set_links(np.array([len(x) for x in own]), np.concatenate(own))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

        for batch in batches:
            for *key, node, own in rows_of(batch, "root", "x", "y", "node", "own"):
                if key != now:
                    yield from flush()
                    now, held = key, {}
                held[node] = own
        yield from flush()

    grouped = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    return grouped.mapInArrow(linked, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = NEAR_TAU, options: tuple[int, ...] = NEAR_PARTS, limit: int = NEAR_BITS, row_col: str | None = None) -> DataFrame:
    """doc_id, row_at, fp, component_id, stays of every row, by links of LIKENESS or more.

    df is scanned twice. row_col names a column that numbers its rows, as numbered() stores it; without one, df is stored first.

    stays is true for one row of each component: that of least id (null last), then of least row_at.
    """
    if row_col is None:
        df, row_col = numbered(df.select(id_col, text_col), "simhash-docs"), "row_at"
    prints, texts = prints_of(True), _texts(df, id_col, text_col, row_col)
    rows = materialise(set_fingerprints(texts), "simhash")
    made = [F.first(F.struct("n_shingles", *prints, "bands")).alias("one")]
    distinct = materialise(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_at")).alias("least"), *made).select("node", "least", "one.*"), "simhash-fp")
    near = materialise(block_links(distinct.select("node", *prints, "bands"), tau, options, limit).distinct(), "simhash-near")
    group = smallest_reachable(near).withColumnRenamed("node", "reached")
    candidates = distinct.join(group, F.col("node") == F.col("reached")).select(F.col("least.row_at").alias("one_at"), "node", "n_shingles", "root")
    links = materialise(alike_links(texts, materialise(candidates, "simhash-groups")).distinct(), "simhash-links")
    named = _named(rows, distinct, links, "row_at", "fp")
    return named.select("doc_id", "row_at", "fp", F.col("component_id.doc_id").alias("component_id"), (F.col("row_at") == F.col("component_id.row_at")).alias("stays"))


def hexadecimal(name: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))


__all__ = ["components", "fingerprint", "fingerprints", "hexadecimal", "near_duplicates", "wide_fingerprint"]
