"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lensmill.llm import queries as q
from lensmill.llm import spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, ()) if one_edit(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def made(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")


def test_whole_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    own = found(q.queries()["op13_spelling"](spark, SF))
    assert own == plain(docs)
    assert any(f for f, *_ in own.values())


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_dense_words(made, most):
    """Words over three letters, so that groups are large and are divided, down to one open letter for most = 1."""
    dealt = random.Random(5)
    words = ["".join(dealt.choice("aaabé") for _ in range(dealt.choice((7, 7, 8, 9)))) for _ in range(400)]
    docs = [(i, " ".join(dealt.choices(words, [1 / (k + 1) for k in range(400)], k=300))) for i in range(20)]
    want = plain(docs)
    assert sum(v[3] for v in want.values()) > 100
    assert found(spelling.variants(made(docs), most=most)) == want


def test_chain_of_forms(made):
    """A root is reached over several steps."""
    texts = [("abcdefghij", 20_000), ("abcdefghijx", 1_500), ("abcdefghijxy", 120), ("abcdefghijxyz", 10), ("bcdefghijxyz", 3)]
    docs = [(k, f"{w} " * n) for k, (w, n) in enumerate(texts)]
    want = plain(docs)
    assert max(len({w, want[w][1]}) for w in want) == 2
    assert found(spelling.variants(made(docs))) == want


def test_edges(spark, made):
    long = "lettersq" * 20_000
    other = long[:70_000] + "x" + long[70_001:]
    rows = [
        (1, "Straße ÀÉÎõüÿþ ÀÉÎõüÿþ aaaaaaa aaaaaaaa"), (1, "Straße ÀÉÎõüÿþ ÀÉÎõüÿþ aaaaaaa aaaaaaaa"), (None, "aaaaaaa,AAAAAAAA;aaaaaaaaa"), (None, None), (3, ""), (4, f"{long} {long} {other} {other}"),
        (5, "aaabaaa aaabaaa aabaaaa aabaaaa aaaabaaa aaaabaaa abcdefg× abcdefg× abcdefg abcdefg"), (6, "short words only"),
    ]
    want = plain(rows)
    for most in (1, 4096):
        assert found(spelling.variants(made(rows), most=most)) == want
    clashing = made(rows).withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    assert found(spelling.variants(clashing)) == want
    assert spelling.variants(made([])).count() == 0
