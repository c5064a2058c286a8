"""The pipeline's stages, one after another over the smallest tables, each against a plain version of its own input."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lensmill.llm import queries as q
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    where = tmp_path_factory.mktemp("pipeline")
    now = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"start": [r.asDict() for r in now.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(str(where / name))
        now = spark.read.parquet(str(where / name))
        out[name] = [r.asDict() for r in now.collect()]
    return out


def test_toxicity(spark, steps):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    kept = {r["doc_id"] for r in steps["toxicity"]}
    assert clean <= kept | {i for i in clean - kept} and len(clean - kept) <= 1
    assert all(r in steps["start"] for r in steps["toxicity"]) and len(kept) >= len(steps["start"]) - 2 * len(toxic) - 10


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_simhash(steps):
    given = sorted(steps["toxicity"], key=lambda r: r["doc_id"])
    kept = {r["doc_id"] for r in steps["simhash"]}
    sets = {r["doc_id"]: shingles(r["text"]) for r in given}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = {(a, b) for a in sets for b in sets if a < b and like(a, b) >= 0.8}
    both = [p for p in near if p[0] in kept and p[1] in kept]
    assert len(both) <= max(1, 0.05 * len(near)) and all(r in given for r in steps["simhash"])
    for gone in set(sets) - kept:
        assert any(like(gone, other) >= 0.6 for other in sets if other != gone)


def test_secrets(steps):
    given = {r["doc_id"]: r for r in steps["simhash"]}
    bare = re.compile("[A-Za-z0-9+/_-]{20,}")
    spans, holders = {}, defaultdict(set)
    for i, r in given.items():
        text, own = r["text"] or "", []
        for kind, a, b in brute.secret_spans(text):
            value = brute.KINDS[0][1].match(text[a:b])[2] if kind == "assign" else text[a:b]
            own.append((a, b, value))
        base = list(own)
        own += [(m.start(), m.end(), m[0]) for m in bare.finditer(text) if all(re.search(x, m[0]) for x in ("[a-z]", "[A-Z]", "[0-9]")) and not any(a < m.end() and m.start() < b for a, b, _ in base)]
        spans[i] = own
        for _, _, value in own:
            holders[value].add((r["source"], text))
    live = {v for v, h in holders.items() if len({s for s, _ in h}) <= 2 and len(h) <= 5}
    for r in steps["secrets"]:
        text, out, at = given[r["doc_id"]]["text"], [], 0
        for a, b, value in sorted(spans[r["doc_id"]]):
            if value in live:
                if a >= at:
                    out += [text[at:a], "[secret]"]
                at = max(at, b)
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == len(r["text"])
    assert len(steps["secrets"]) == len(given)


def test_mixing(steps):
    given = steps["secrets"]
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in given}
    by_source = defaultdict(int)
    for r in given:
        by_source[r["source"]] += size[r["doc_id"]]
    copies = Counter(r["doc_id"] for r in steps["mixing"])
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by_source))}
    left, target = sum(by_source.values()), {}
    while True:
        level = (left - sum(3 * by_source[s] for s in target)) / sum(w for s, w in weights.items() if s not in target)
        above = [s for s in weights if s not in target and level * weights[s] > 3 * by_source[s]]
        if not above:
            break
        target |= {s: 3 * by_source[s] for s in above}
    goals = {s: target.get(s, level * w) for s, w in weights.items()}
    order = lambda r: (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), r["doc_id"])
    for s, total in by_source.items():
        at = 0
        for r in sorted((r for r in given if r["source"] == s), key=order):
            n = size[r["doc_id"]]
            want = max(0, min(3, int((goals[s] - at - n / 2) // total) + 1)) if n else 0
            assert copies[r["doc_id"]] == want
            at += n


def test_bpe(steps):
    import tiktoken

    path, pattern = q.tokenizer_paths()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in steps["mixing"]}
    assert len(steps["bpe"]) == len(steps["mixing"])
    for r in steps["bpe"]:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(texts[r["doc_id"]]))
