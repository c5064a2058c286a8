"""Sharding and mixing where every range and bucket holds a few rows, against plain sorts, with ids that repeat or are null."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lensmill.llm import bottomk, mixing, sharding
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    """600 rows: a third under one id, some without one, groups of copies, and one group larger than a shard."""
    i = F.col("id")
    text = F.when(i % 10 < 4, F.lit("one text of the large group")).when(i % 7 == 0, F.concat(F.lit("group "), (i % 5).cast("string"))).otherwise(F.concat(F.repeat(F.lit("word "), (i % 50).cast("int")), i))
    doc_id = F.when(i % 3 == 0, 7).when(i % 11 > 0, i)
    own = spark.range(600).select(doc_id.cast("long").alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), (i % 4 % 3).cast("string")).alias("source"))
    return own.repartition(3).cache()


def sharded(docs, shards, whole=0.1):
    """(doc_id, text) in order, with the shard and slot of each."""
    key = lambda r: (int(hashlib.md5((r.text or "").encode()).hexdigest()[:15], 16), -(1 << 63) if r.doc_id is None else r.doc_id)
    rows = sorted(docs.collect(), key=key)
    sizes = [len(r.text.encode()) + 16 for r in rows]
    capacity, end, own, spans = sum(sizes) / shards, 0, [], {}
    for r, n in zip(rows, sizes, strict=True):
        end += n
        own.append(min(shards - 1, int((end - n / 2) / capacity)))
        first, _, lo, hi = spans.get(r.text, (end - n, 0, own[-1], 0))
        spans[r.text] = (first, end, lo, own[-1])
    for k, r in enumerate(rows):
        a, b, lo, hi = spans[r.text]
        if lo < hi and b - a <= whole * capacity:
            own[k] = min(shards - 1, int((a + b) / 2 / capacity))
    slot = {}
    out = []
    for r, s in zip(rows, own, strict=True):
        out.append((-1 if r.doc_id is None else r.doc_id, zlib.crc32(r.text.encode()), s, slot.setdefault(s, 0)))
        slot[s] += 1
    return sorted(out)


@pytest.mark.parametrize("per_range", [20, 3])
def test_sharding_over_many_ranges(docs, monkeypatch, per_range):
    cuts = []
    found_cuts = sharding.splitters
    monkeypatch.setattr(sharding, "RANGE_ROWS", per_range)
    monkeypatch.setattr(sharding, "splitters", lambda *a: cuts.extend(found_cuts(*a)) or cuts)
    found = sharding.shard(docs, shards=12).collect()
    assert len(cuts) > 400 // per_range // 2
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.shard, r.slot) for r in found) == sharded(docs, 12)


def test_overfull_ranges_are_cut_again(docs, monkeypatch):
    """A sample that saw hardly anything leaves overfull ranges; each round cuts them."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    drawn, rounds = sharding.drawn, []

    def poor(rows, chance, salt, *columns):
        rounds.append(salt)
        return drawn(rows, chance / 40 if salt == 1 else chance, salt, *columns)

    monkeypatch.setattr(sharding, "drawn", poor)
    found = sharding.shard(docs, shards=12).collect()
    assert len(rounds) > 1
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.shard, r.slot) for r in found) == sharded(docs, 12)


def test_mixing_over_many_buckets(docs, monkeypatch):
    """Buckets of seven rows give what one bucket a source gives; sums over a source do not depend on ids."""
    shown = lambda: sorted(((-1 if r.doc_id is None else r.doc_id, r.source, r.size, r.taken, round(r.position or -1, 9)) for r in mixing.mix(docs).collect()))
    whole = shown()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert shown() == whole and len(whole) == 600
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(brute.words(r.text))
    taken = {s: sum(x[3] for x in whole if x[1] == s) for s in size}
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert all(abs(taken[s] - target[s]) <= 51 for s in size)


def test_mixing_of_one_id(spark, monkeypatch):
    """Rows of one id, and rows that repeat in every column, lie in many ranges of the tape."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    i = F.col("id")
    own = spark.range(400).select(F.when(i % 8 == 0, i).cast("long").alias("doc_id"), F.when(i % 2 == 0, "a b c").otherwise(F.repeat(F.lit("w "), (i % 30).cast("int"))).alias("text"), F.lit("s").alias("source"))
    rows = mixing.numbered(mixing.sized(own), "test-sizes")
    tape = mixing.laid_out(rows, mixing.targets(rows), 3).select("pick", "doc_id", "size", "mark", "middle").collect()
    assert len({r.pick for r in tape}) == 51 and len(tape) == 400
    tape.sort(key=lambda r: r.middle)
    at = 0
    for r in tape:
        if r.size:
            assert r.middle == at + r.size / 2
            at += r.size
    key = [(r.pick, r.doc_id is not None, r.doc_id or 0, r.size, r.mark) for r in tape if r.size]
    assert key == sorted(key)


@pytest.mark.parametrize("large", [3, 1_000])
def test_fingerprints_of_one_id(spark, docs, monkeypatch, large):
    """A third of the rows under one id or none, texts that repeat under it: each row's next is that of a plain sort."""
    monkeypatch.setattr(bottomk, "LARGE_ROWS", large)
    marked = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("mark")).collect()
    rows = sorted(marked, key=lambda r: ((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.mark))
    expected = []
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(r.text) // 4
        a, b = bottomk.sketch(r.text), bottomk.sketch(after.text)
        expected.append((-1 if r.doc_id is None else r.doc_id, len(r.text), brute.sha(r.text[: len(r.text) - n] + after.text[:n]), bottomk.spelled(a), bottomk.resemblance(a, b)))
    found = bottomk.compared_with_next(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in found) == sorted(expected)
