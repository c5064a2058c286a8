"""Repeats in long texts, passages that most documents share, ids that repeat, against all 100-byte strings."""

import numpy as np
import pytest

from lensmill.llm import suffixes
from tests.llm import brute


def noise(seed, n):
    return bytes(np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8)).decode()


def same_as_brute(spark, docs, partitions=4):
    found = {r.doc_id: r for r in suffixes.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(partitions)).collect()}
    for (i, text), gone in zip(docs, brute.removed([(i, t.encode()) for i, t in docs]), strict=True):
        data = text.encode()
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (len(data), int(gone.sum()), runs, brute.sha(kept)), i
    return found


def test_a_passage_of_every_document(spark):
    passage = noise(0, 260)
    found = same_as_brute(spark, [(i, noise(2 * i + 1, 150 + i % 90) + passage + noise(2 * i + 2, 150)) for i in range(600)])
    assert found[0].n_removed == 0 and all(found[i].n_removed >= 260 for i in range(1, 600))


def test_long_texts(spark):
    """Over two pieces of 1 MiB, a passage across a cut, a period, and the same passage in a short text before and after."""
    across = noise(7, 400)
    long = noise(8, suffixes.PIECE - 200) + across + noise(9, suffixes.PIECE) + across
    found = same_as_brute(spark, [(1, noise(1, 50) + across), (2, long), (3, "abcdefg" * 40_000), (4, across[150:300] + noise(4, 99)), (5, "")])
    assert found[2].n_removed >= 800 and found[2].n_spans == 2 and found[4].n_removed == 150


def test_equal_windows_of_one_chunk_go_together():
    key, start = np.array([4, 1, 1, 1, 1, 1]), np.array([9, 8, 5, 6, 7, 300])
    assert [x.tolist() for x in suffixes._neighbours(key, start)] == [[1, 1, 4], [5, 300, 9], [3, 0, 0]]
    many = np.arange(1000)
    first, after = suffixes._neighbours(np.zeros(1000, np.int64), many)[1:]
    assert after.max() <= 255 and sorted(x for a, n in zip(first, after, strict=True) for x in range(a, a + n + 1)) == many.tolist()
    h, two = np.array([3, 1, 3, 3], np.uint64), np.array([0, 0, 0, 1], np.uint64)
    own, again = suffixes._told_apart(h, two, np.array([5, 5, 2, 2]), np.array([1, 2, 3, 4]))
    assert [c.tolist() for c in own] == [[1, 3, 3], [0, 0, 1], [5, 2, 2], [2, 3, 4]] and [c.tolist() for c in again] == [[5], [1]]


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None if i % 3 else i])
def test_buckets_do_not_change_results_of_repeated_ids(spark, ids, monkeypatch):
    docs = [(ids(i), noise(i, 120) + noise(1000 + i % 9, 160)) for i in range(80)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    few = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.deduplicate(table).collect())
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 100)
    assert sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.deduplicate(table).collect()) == few
    assert sum(n for _, n, _ in few) >= 71 * 160
