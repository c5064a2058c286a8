"""The language model against a plain version that looks every n-gram up in one table."""

import math
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lensmill.llm import queries as q
from lensmill.llm import scoring

SF = "/root/testdata/sf0.001"


def plain(docs, order=scoring.ORDER, s=scoring.STRENGTH):
    lower = {c: c + 32 for c in range(65, 91)}
    own = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [0, *(text or "").translate(lower).encode().split(), 1]) for i, text in docs]
    c = Counter()
    for _, out, words in own:
        if not out:
            for k in range(1, order + 1):
                c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    single = {w: n for w, n in c.items() if len(w) == 1 and w != (0,)}
    total, types = sum(single.values()), len(single)
    once, twice = (sum(n == k for n in single.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))

    def p(gram):
        if len(gram) == 1:
            return (c[gram] - d if c[gram] else d * types) / total if total else 1.0
        return (c[gram] + s * p(gram[1:])) / (c[gram[:-1]] + s)

    out = {}
    for i, fold, words in own:
        base = sum(math.log10((c[w,] + 1) / (total + types + 1)) for w in words[1:])
        score = sum(math.log10(p(tuple(words[max(0, k - order + 1) : k + 1]))) for k in range(1, len(words)))
        out.setdefault(i, []).append((fold, len(words) - 1, sum(c[w,] > 0 for w in words[1:]), total, base, score))
    return out


def check(df, want):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert found.keys() == want.keys()
    for i, own in found.items():
        for a, b in zip(sorted(own), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-12) and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-12)
    return found


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def test_whole_table(spark, docs):
    found = check(q.queries()["op11_lm"](spark, SF), plain(docs))
    held = [x[0] for x in found.values() if x[0][0]]
    assert sum(x[5] > x[4] for x in held) > 0.95 * len(held)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_chunks_and_buckets(spark, docs, order):
    """Many chunks and buckets: every chunk gets its arcs from all the others."""
    own = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    check(scoring.score(own, order, chunk_bytes=20_000, bucket_bytes=30_000), plain(docs, order))


def test_probabilities_sum_to_one(spark):
    """After the same words, those that were seen and one that never was share a probability of 1."""
    folds = {out: [k for k in range(1000) if (zlib.crc32(str(k).encode()) % 7 == 2) == out] for out in (False, True)}
    train = list(zip(folds[False], ("a b a b c d", "b a b x", "a c"), strict=False))
    probes = list(zip(folds[True], [f"a b {w}" for w in (*"abcdx", "never")] + ["a b"], strict=False))
    found = {r.doc_id: r.score for r in scoring.score(spark.createDataFrame(train + probes, "doc_id bigint, text string"), order=3, strength=2.0).collect()}
    model = plain(train + probes, 3, 2.0)
    assert all(found[i] == pytest.approx(model[i][0][5]) for i, _ in probes)
    p = probability(train)
    assert sum(p(("a", "b", w)) for w in (*"abcdx", "never", "end")) == pytest.approx(1)


def probability(train, s=2.0):
    """p of the plain version's formula, with the end spelled out."""
    texts = [["start", *t.split(), "end"] for _, t in train]
    n = Counter(tuple(t[i : i + k]) for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1))
    single = {g: v for g, v in n.items() if len(g) == 1 and g != ("start",)}
    once, twice = (sum(v == k for v in single.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    total = sum(single.values())

    def p(g):
        if len(g) == 1:
            return (n[g] - d if n[g] else d * len(single)) / total
        return (n[g] + s * p(g[1:])) / (n[g[:-1]] + s)

    return p


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a B"), (None, "A b"), (4, "É é É"), (5, "word " * 60_000), (5, "word " * 60_000), (6, "a b a b"), (9, "unseen words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain(rows)
    check(scoring.score(df), want)
    check(scoring.score(df.withColumn("kind", F.lit("x")).withColumn("chunk", F.lit(None)), chunk_bytes=10), want)
    assert scoring.score(df.limit(0)).count() == 0
    out = [(i, "only held out") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert {(r.base_score, r.score, r.train_tokens, r.n_known) for r in scoring.score(spark.createDataFrame(out, "doc_id bigint, text string")).collect()} == {(0.0, 0.0, 0, 0)}
