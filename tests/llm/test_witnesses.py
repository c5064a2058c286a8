"""Arithmetic of op5 and op8 against plain loops over Python numbers."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from lensmill.llm import bottomk, langid
from lensmill.llm import queries as q
from tests.llm import brute

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def plain_sketch(text):
    """Every shingle's hash, sorted, the least 128 of the distinct ones."""
    words = [xxhash.xxh64_intdigest(w, 7) for w in text.encode().split()]
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    hashes = set()
    for s in shingles:
        h = len(s)
        for w in s:
            h = (h ^ w) * 0x9E3779B97F4A7C15 & MASK
            h ^= h >> 29
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
        h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
        hashes.add(h ^ h >> 31)
    return sorted(hashes)[:128]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted({*a, *b})[:128]
    return sum(x in a and x in b for x in union) / len(union)


def test_fingerprints(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found = {r.doc_id: r for r in q.queries()["op8_fingerprints"](spark, SF).collect()}
    assert len(found) == len(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        own, other, following = map(plain_sketch, (text, changed, after))
        spelled = ["".join(f"{h:016x}" for h in s) for s in (own, other)]
        assert [found[i].n_chars, found[i].fingerprint, found[i].edited_fingerprint, found[i].edited_sha256] == [len(text), *spelled, brute.sha(changed)]
        assert (found[i].near_edited, found[i].near_next) == (plain_likeness(own, other), plain_likeness(own, following))


@pytest.mark.parametrize("text", ["", " \n", "one", "a b c d e", "a b c d e f " * 400, "x " * 9 + "é y z"])
def test_sketches(text):
    assert bottomk.sketch(text).tolist() == plain_sketch(text)


def plain_grams(text):
    raw = b" " + b" ".join(text.lower().encode().translate(langid._FOLD).split()) + b" "
    out = Counter()
    for n in langid.GRAMS:
        for i in range(len(raw) - n + 1):
            code = 0
            for b in raw[i : i + n]:
                code = (code * 257 + b + 1) % (1 << 32)
            out[(code * int(langid._MULTIPLIER) % (1 << 32)) * langid.DIMENSIONS >> 32] += 1
    return out


def unit(v):
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else v


def dot(a, b):
    return sum(x * b.get(k, 0) for k, x in a.items())


def mean(vectors):
    out = Counter()
    for v in vectors:
        for k, x in v.items():
            out[k] += x / len(vectors)
    return unit(out)


TEXTS = {
    "en": ["the cat sat on the mat with the hat", "the dog and the cat ran to the house", "rain falls on the hills and on the town", "ships sail over the sea to the harbour"],
    "de": ["der Hund und die Katze im Haus", "die Schiffe fahren über das Meer zum Hafen", "Regen fällt auf die Hügel und die Stadt", "das Brot liegt auf dem Tisch in der Küche"],
}


def test_language_by_plain_loops():
    rows = sorted((lang, k, t) for lang, texts in TEXTS.items() for k, t in enumerate(texts))
    counts = [plain_grams(t) for *_, t in rows]
    for (*_, t), own in zip(rows, counts, strict=True):
        assert {k: int(x) for k, x in enumerate(langid.gram_counts(t)) if x} == own
    idf = {k: math.log((1 + len(rows)) / (1 + n)) + 1 for k, n in Counter(k for c in counts for k in c).items()}
    rare = math.log(1 + len(rows)) + 1
    vector = lambda c: unit({k: x * idf.get(k, rare) for k, x in c.items()})
    vectors = list(map(vector, counts))
    centroids = []
    for lang in sorted(TEXTS):
        own = [v for (name, *_), v in zip(rows, vectors, strict=True) if name == lang]
        first = Counter()
        for v in own:
            for k, x in v.items():
                first[k] += x / len(own)
        held = [first]  # the farthest vector is looked for before the mean is made a unit
        while len(held) < 2:
            held.append(min(own, key=lambda v: max(dot(v, c) for c in held)))
        held = [unit(c) for c in held]
        for _ in range(12):
            near = [max(range(2), key=lambda k: dot(v, held[k])) for v in own]
            held = [mean([v for v, n in zip(own, near, strict=True) if n == k]) if k in near else held[k] for k in range(2)]
        centroids += [(lang, c) for c in held]
    model = langid.fit_rows([(a, k, t) for a, k, t in rows], 2, 1.5)
    assert [model.languages[o] for o in model.owner] == [lang for lang, _ in centroids]
    for row, (_, c) in zip(model.centroids, centroids, strict=True):
        assert np.allclose(row, [c.get(k, 0) for k in range(langid.DIMENSIONS)], atol=1e-5)
    asked = ["the hat and the town", "die Stadt und das Meer", "zzz qqq", "123", None]
    langs, scores, _ = model.predict(asked)
    assert langs[3:] == ["und", "und"] and scores[3:] == [0, 0]
    for text, lang, score in zip(asked[:3], langs, scores, strict=False):
        best = max(centroids, key=lambda c: dot(vector(plain_grams(text)), c[1]))
        assert math.isclose(score, dot(vector(plain_grams(text)), best[1]), abs_tol=1e-5)
        assert lang == best[0] or score < 1e-5
    assert langs[:2] == ["en", "de"]
