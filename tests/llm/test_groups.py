"""Ways that only large inputs take: many shares of links, large groups of vectors, slabs of fingerprints, halved lists of holders."""

import random

import numpy as np
import pytest

from lensmill.llm import components, neighbours, simhash
from tests.llm import brute


def least_of(n, linked):
    root = brute.components(n, linked)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(i, least.get(r, i))
    return [least[r] for r in root]


@pytest.mark.parametrize("share", [3, 50, 1 << 20])
def test_shares(spark, share):
    rng = random.Random(share)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(200, 200)]
    own = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r.node: r.root for r in components.smallest_reachable(own, share=share).collect()}
    least = least_of(231, links)
    assert found == {i: least[i] for i in {i for a, b in links for i in (a, b) if a != b}}
    assert components.smallest_reachable(own.where("false"), share=share).count() == 0


def test_large_groups_of_vectors(spark):
    """Groups over the bound go by buckets, with the same links."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((60, 32)), rng.integers(1, 12, 60), axis=0)
    x = x + 0.25 * rng.standard_normal(x.shape)
    x = np.concatenate([x, x[::5], x[::10]])
    own = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    rows = [sorted(map(tuple, neighbours.near_duplicates(own, recall=1 - 1e-9, group=g).collect())) for g in (1, 4096)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    least = least_of(len(x), np.argwhere(near).tolist())
    assert rows[0] == rows[1] == [(i, int(near[i].sum()), least[i], least[i] == i) for i in range(len(x))] and near.sum(axis=1).max() > 5


def linked_places(n, a, b):
    return least_of(n, list(zip(a.tolist(), b.tolist(), strict=True)))


@pytest.mark.parametrize("clusters", [1, 40, 600])
def test_print_links(clusters):
    """Walks and slabs find the components of all pairs with an own row."""
    rng = np.random.default_rng(clusters)
    n = 600
    centres = rng.integers(0, 1 << 63, (clusters, 2), dtype=np.uint64)
    prints = centres[rng.integers(0, clusters, n)]
    prints ^= np.left_shift(np.uint64(1), rng.integers(0, 64, (n, 2), dtype=np.uint64))
    own = rng.random(n) < 0.7
    off = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    pairs = np.argwhere((off <= 4) & (own[:, None] | own[None]))
    assert linked_places(n, *simhash.print_links(own, prints, 4)) == least_of(n, pairs.tolist())


def test_set_links():
    rng = np.random.default_rng(5)
    sets = []
    for k in range(30):
        base = rng.choice(1000, 40, replace=False) + 1000 * (k % 7)
        sets += [np.unique(np.concatenate([base[rng.random(40) < 0.95], rng.integers(10_000, 20_000, 1)])) for _ in range(12)]
    sets.append(np.empty(0, np.int64))
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    found = simhash.set_links(np.array([len(s) for s in sets]), np.concatenate(sets).astype(np.uint64))
    assert linked_places(len(sets), *found) == least_of(len(sets), alike) and len(alike) > 100
