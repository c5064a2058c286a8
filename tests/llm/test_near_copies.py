"""Near copies against brute force over sets of five-word shingles."""

import random

import corpus_pipeline
from lensmill.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def like(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def fresh(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def linked(spark, texts):
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(own).collect()}


def test_repeated_line(spark):
    """A repeated line makes no near copy, nor does a likeness just below 0.8; one just above does."""
    rng = random.Random(1)
    line = fresh(rng, 10)
    texts = [" ".join(fresh(rng, 150) + line * n + fresh(rng, 150)) for n in (20, 40, 80) for _ in range(8)]
    base = fresh(rng, 204)
    texts += [" ".join(base), " ".join(base + fresh(rng, 60)), " ".join(base[:164] + fresh(rng, 60))]
    assert like(texts[24], texts[25]) < 0.8 and like(texts[24], texts[26]) < 0.8
    found = linked(spark, texts)
    assert all(found[i] == i for i in found)
    above = [" ".join(base), " ".join(base + fresh(rng, 49))]
    assert 0.8 <= like(*above) < 0.81 and linked(spark, above) == {0: 0, 1: 0}


def test_recall(spark):
    """Copies appended to, cut off, with a passage swapped and with scattered words swapped, all at 0.8 to 0.82."""
    rng, texts = random.Random(2), []
    for n in (60, 200, 800):
        for _ in range(20):
            base, new = fresh(rng, n + 4), fresh(rng, n)
            cut = (len(base) - 4) * 81 // 100 + 4
            k = n // 10 - 4
            some, step = list(base), (n + 4) // max(1, n // 50)
            for at in range(step // 2, n, step):
                some[at] = new[at]
            for kind, copy in enumerate((base + new[: n * 23 // 100], base[:cut], base[: n // 3] + new[:k] + base[n // 3 + k :], some)):
                texts += [" ".join(f"{w}k{kind}" for w in t) for t in (base, copy)]
    near = [i for i in range(0, len(texts), 2) if like(texts[i], texts[i + 1]) >= 0.8]
    found = linked(spark, texts)
    met = sum(found[i + 1] == found[i] for i in near)
    print(len(near), met)
    assert len(near) > 180 and met >= 0.99 * len(near)


def test_one_row_stays(spark, tmp_path):
    """Of copies with null ids, repeated rows, and another text under a kept id, one row of each group stays."""
    rng = random.Random(3)
    a, b, c = (" ".join(fresh(rng, 80)) for _ in range(3))
    rows = [(None, a), (None, a + " more"), (None, a), (5, b), (5, b), (4, c), (5, c), (None, c)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(4).write.parquet(str(tmp_path / "docs"))
    out = corpus_pipeline.simhash_stage(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    found = sorted((r.doc_id or 0, r.text[:20]) for r in out.collect())
    assert found == sorted([(0, a[:20]), (5, b[:20]), (4, c[:20])])
