"""Each query against a plain version, over all documents of the small test table."""

import base64
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lensmill.llm import queries as q
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").df()


def rows(spark, name, sf=SF):
    return {r[0]: r for r in q.queries()[name](spark, sf).collect()}


def test_secrets(spark, docs):
    found = rows(spark, "op1_secrets")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        spans = brute.secret_spans(text)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert found[i].base_sha256 == brute.sha(base)
        assert set(filter(None, base.split(","))) <= set(found[i].spans.split(","))
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex) == tuple(sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex"))


def test_mixing(spark, docs):
    found = rows(spark, "op2_mixing")
    size = {i: len(brute.words(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    by_source = defaultdict(int)
    for i, s in zip(docs.doc_id, docs.source, strict=True):
        by_source[s] += size[i]
    names = sorted(by_source, key=lambda s: s.encode())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, held = {}, set()
    while True:
        left = sum(by_source.values()) - sum(3 * by_source[s] for s in held)
        open_ = [s for s in names if s not in held]
        target = {s: 3 * by_source[s] for s in held} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > 3 * by_source[s]}
        if not above:
            break
        held |= above
    taken = defaultdict(int)
    for i, s in zip(docs.doc_id, docs.source, strict=True):
        assert found[i].size == size[i] and found[i].source_size == by_source[s]
        assert math.isclose(found[i].target, target[s], rel_tol=1e-9)
        assert 0 <= found[i].taken <= 3 * size[i]
        taken[s] += found[i].taken
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in names)


def test_bpe(spark, docs):
    import tiktoken

    path, pattern = q.tokenizer_paths()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    found = rows(spark, "op3_bpe")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = enc.encode_ordinary(text)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))


def test_sharding(spark, docs):
    found = rows(spark, "op4_sharding", "/root/testdata/sf0.01")
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    shards, slots = defaultdict(int), defaultdict(list)
    for i, text in texts.items():
        r = found[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "bytes", None)
        shards[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(shards) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, longest = sum(shards.values()) / 40, max(r.size for r in found.values())
    assert max(shards.values()) <= 1.2 * mean + longest and min(shards.values()) >= 0.8 * mean - longest


def test_language(spark):
    docs = duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    found = rows(spark, "op5_langid", "/root/testdata/sf0.01")
    held = [(i, lang) for i, lang in docs if brute.is_held_out(i)]
    assert all(found[i].held_out == brute.is_held_out(i) and 0 <= found[i].score <= 1 for i, _ in docs)
    assert np.mean([found[i].lang_pred == lang for i, lang in held]) > 0.97


def test_toxicity(spark):
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    found = rows(spark, "op6_toxicity", "/root/testdata/sf0.01")
    held = [(i, y) for i, y in labels if brute.is_held_out(i)]
    assert np.mean([found[i].predicted == y for i, y in held]) > 0.93
    assert all(found[i].predicted == (found[i].score >= 0.5) for i, _ in labels)
    assert sum(found[i].predicted for i, y in labels if y == 0) <= 3


def test_neighbours(spark):
    v = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").df()
    x = np.stack(v.embedding.values).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = brute.components(len(x), np.argwhere(near))
    least = {r: min(int(v.vec_id[i]) for i in range(len(x)) if root[i] == r) for r in set(root)}
    found = rows(spark, "op7_neighbours")
    for i, vec in enumerate(v.vec_id):
        assert (found[vec].n_links, found[vec].component_id, found[vec].kept) == (near[i].sum(), least[root[i]], least[root[i]] == vec)


def test_fingerprints(spark, docs):
    from lensmill.llm import bottomk

    found = rows(spark, "op8_fingerprints")
    ids, texts = list(docs.doc_id), list(docs.text)
    for i, text, after in zip(ids, texts, texts[1:] + texts[:1], strict=True):
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        own, other, nxt = (bottomk.sketch(t) for t in (text, changed, after))
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(changed))
        assert (r.fingerprint, r.edited_fingerprint) == (bottomk.spelled(own), bottomk.spelled(other))
        assert (r.near_edited, r.near_next) == (bottomk.resemblance(own, other), bottomk.resemblance(own, nxt))
        sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (text.encode().split(), changed.encode().split())]
        assert abs(r.near_edited - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.2


def test_simhash(spark, docs):
    found = rows(spark, "op9_simhash")
    fps = [brute.simhash(t) for t in docs.text]
    root = brute.components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {r: min(int(docs.doc_id[i]) for i in range(len(fps)) if root[i] == r) for r in set(root)}
    for k, i in enumerate(docs.doc_id):
        assert (found[i].fingerprint, found[i].component_id) == (f"{fps[k]:016x}", least[root[k]])


def test_suffixes(spark, docs):
    found = rows(spark, "op10_suffixes")
    data = [(i, t.encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)]
    for (i, raw), mask in zip(data, brute.removed(data), strict=True):
        spans = int(mask[0]) + int((np.diff(mask.astype(int)) == 1).sum()) if len(mask) else 0
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (len(raw), mask.sum(), spans, brute.sha(kept))
