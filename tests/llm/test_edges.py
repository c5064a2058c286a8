"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lensmill.llm import bottomk, bpe, langid, mixing, neighbours, secrets, sharding, simhash, suffixes, toxicity
from lensmill.llm.queries import tokenizer_paths
from tests.llm import brute

LONG = "lorem ipsum dolor sit amet " * 9000
SECRET = "password = abcdefghijkl123"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, LONG, "la", "b"),
    (6, "ü漢字🙂 \x00 é " + SECRET, "de", "c"),
    (7, " \t\n", None, "c"),
    (None, "no id here", "en", None),
    (8, "one", "en", "a"),
    (8, "one", "en", "a"),
    (9, "12345 !!", "en", "a"),
    (10, "a b c d e f g h i j " * 30, "en", "a"),
]
CLASH = ("size", "shard", "slot", "key", "fp", "node", "uid", "bucket", "own", "spans", "base", "target", "copies", "pick", "range", "label_id", "toxic", "score")


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(*r, 7) for r in TEXTS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return own.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)] + [(None, 1, None)], "doc_id bigint, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(TEXTS) and len(out[8]) == 2
    return out


def test_secrets(docs, none):
    found = by_id(secrets.digests(docs))
    for i, t, *_ in TEXTS:
        assert found[i][0].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.secret_spans(t)))
    assert secrets.digests(none).count() == 0
    redacted = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert "abcdefghijkl" not in redacted[6] and redacted[3] is None and redacted[1] == TEXTS[0][1]


def test_ownership(spark):
    rows = [(i, f"x{i} token=AbcDefGhi1234567", f"s{i}") for i in range(9)] + [(99, "token=ZbcDefGhi1234567 and bare Qq1Qq1Qq1Qq1Qq1Qq1Qq1 end", "s0")]
    own = {r.doc_id: r for r in secrets.digests(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert own[3].n_live == 0 and own[3].n_example == 1 and own[99].n_live == 2 and "bare:" in own[99].spans


def test_many_spans_in_one_text(spark):
    """More spans than a block holds, base and bare, beside and within each other."""
    kinds = ("password=Aa{0}bcdefghijk", "AKIA{0:016d}", "{0:020x}", "Zz{0}Zz1Zz1Zz1Zz1Zz1Zz1", "token={0:016x}/Qq1Qq1Qq1Qq1Qq1Qq1")
    texts = [" ".join(kinds[(i * 7 + i // 3) % 5].format(i) for i in range(n)) for n in (255, 256, 257, 1300)]
    found = {r.doc_id: r for r in secrets.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("s")), max_repos=9).collect()}
    for i, text in enumerate(texts):
        base = brute.secret_spans(text)
        bare = [("bare", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
        bare = [(k, a, b) for k, a, b in bare if not any(x < b and a < y for _, x, y in base)]
        assert len(bare) > 40
        assert set(found[i].spans.split(",")) == {f"{k}:{a}:{b}" for k, a, b in base + bare}
        assert found[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))


def test_mixing(docs, none):
    found = by_id(mixing.mix(docs))
    assert found[3][0].size == 0 and found[3][0].taken == 0 and all(r.taken <= 3 * r.size for rows in found.values() for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.apply(none).count() == 0
    taken = sum(r.copies for rows in found.values() for r in rows)
    assert mixing.apply(docs).count() == taken


def test_bpe(docs, none):
    path, pattern = tokenizer_paths()
    found = by_id(bpe.digests(docs, path, pattern))
    assert found[3][0].n_tokens == 0 and all(found[i][0].decoded_sha256 == brute.sha(t or "") for i, t, *_ in TEXTS)
    ids = bpe.encode(docs, path, pattern)
    back = {r.doc_id: r.text for r in bpe.decode(ids, path, pattern).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in TEXTS)
    one = {r.doc_id: r for r in ids.collect()}[6]
    assert one.ends[-1] == len(TEXTS[5][1]) and all(a < b for a, b in zip(one.starts, one.ends, strict=True))
    assert bpe.coder(path, pattern).decode(one.ids[:2]).decode("utf-8", "replace")
    assert bpe.digests(none, path, pattern).count() == 0


def test_sharding(docs, none):
    found = by_id(sharding.shard(docs, shards=3))
    assert found[3][0].size == 16 and found[3][0].text_crc32 == 0
    slots = {}
    for rows in found.values():
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).count() == 0


def test_repeated_id_teaches_once(spark):
    own = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    taught = langid.sample(own, per_lang=50).collect()
    assert len(taught) == 50 and len({r.pick for r in taught}) == 50
    assert langid.sample(own.where("doc_id = 7"), per_lang=50).collect()[0].text == "text 0"


def test_hot_group_is_divided(spark):
    own = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.concat(F.lit("own text "), "id")).alias("text"))
    sizes = sharding.shard(own, shards=10).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("c")).collect()
    assert len(sizes) == 10 and max(r.n for r in sizes) < 1.1 * min(r.n for r in sizes)


def test_langid(docs, none):
    model = langid.fit(langid.sample(docs))
    found = by_id(langid.identify(docs, model))
    assert all(found[i][0].lang_pred == "und" for i in (3, 4, 7, 9)) and found[5][0].lang_pred != "und"
    nothing = langid.fit(langid.sample(none))
    assert by_id(langid.identify(docs, nothing))[1][0].lang_pred == "und" and langid.identify(none, model).count() == 0


def test_toxicity(spark, docs, none):
    model = toxicity.fit(toxicity.sample(docs, labels(spark)))
    found = by_id(toxicity.score(docs, model))
    assert all(0 <= r.score <= 1 for rows in found.values() for r in rows)
    nothing = toxicity.fit(toxicity.sample(none, labels(spark)))
    assert toxicity.score(none, nothing).count() == 0 and all(r.score < 0.5 for rows in by_id(toxicity.score(docs, nothing)).values() for r in rows)


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1e300, 1e-300]), (9, [-1.0, 0.0])]
    own = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"uid": F.lit(1), "n_links": F.lit(2)})
    found = {}
    for r in neighbours.near_duplicates(own).collect():
        found.setdefault(r.vec_id, []).append(tuple(r)[1:])
    assert found[1] == [(3, 1, True)] and found[2] == [(3, 1, False)] * 2 and found[None][0][:2] == (3, 1)
    assert all(found[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9))
    assert neighbours.near_duplicates(own.where("false")).count() == 0


def test_hot_bucket(spark):
    own = spark.range(2500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") / 1e6, F.lit(0.5)).alias("embedding"))
    assert neighbours.near_duplicates(own).where("n_links = 2499 AND component_id = 0").count() == 2500


def test_fingerprints(docs, none):
    found = by_id(bottomk.compared_with_next(docs))
    texts = [t or "" for _, t, *_ in sorted((r for r in TEXTS), key=lambda r: (r[0] is None, r[0] or 0))]
    ids = sorted((r[0] for r in TEXTS), key=lambda i: (i is None, i or 0))
    for i, text, after in zip(ids, texts, texts[1:] + texts[:1], strict=True):
        assert brute.sha(bottomk.edited(text, after)) in {r.edited_sha256 for r in found[i]}
        assert bottomk.spelled(bottomk.sketch(bottomk.edited(text, after))) in {r.edited_fingerprint for r in found[i]}
    assert found[3][0].fingerprint == "" and found[1][0].fingerprint == found[2][0].fingerprint
    assert bottomk.compared_with_next(none).count() == 0
    a, b = bottomk.sketch(TEXTS[0][1]), bottomk.sketch(TEXTS[11][1])
    assert bottomk.containment(a, bottomk.merge(a, b)) == 1 and (bottomk.unspelled(bottomk.spelled(a)) == a).all()


def test_simhash(docs, none):
    found = by_id(simhash.components(docs))
    root = brute.components(len(TEXTS), [(a, b) for a in range(len(TEXTS)) for b in range(a) if (brute.simhash(TEXTS[a][1]) ^ brute.simhash(TEXTS[b][1])).bit_count() <= 2])
    for k, (i, t, *_) in enumerate(TEXTS):
        least = min((TEXTS[j][0] for j in range(len(TEXTS)) if root[j] == root[k] and TEXTS[j][0] is not None), default=None)
        assert found[i][0].component_id == least and found[i][0].fp % (1 << 64) == brute.simhash(t)
    assert simhash.components(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_near_copies(spark):
    words = [f"w{i * 7919 % 997}" for i in range(300)]
    copies = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(20, 280, 20)]
    own = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(words), *copies, " ".join(reversed(words))])], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(own).collect()}
    assert {found[i] for i in range(14)} == {0} and found[14] == 14


def test_suffixes(docs, none):
    found = by_id(suffixes.deduplicate(docs))
    order = sorted({(i, t or "") for i, t, *_ in TEXTS}, key=lambda r: (r[0] is None, r[0] or 0))
    data = [(i, t.encode()) for i, t in order if len(t) < 20_000]
    for (i, _), mask in zip(data, brute.removed(data), strict=True):
        assert found[i][0].n_removed == mask.sum()
    assert found[5][0].n_removed == len(LONG) - len("lorem ipsum dolor sit amet ") and suffixes.deduplicate(none).count() == 0


def test_suffixes_of_repeated_ids(spark):
    text = (brute.sha("a") + brute.sha("b") + brute.sha("c"))[:150]
    own = spark.createDataFrame([(1, text), (1, text), (1, "x" + text), (2, text)], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.deduplicate(own).collect())
    assert found[-1] == (2, 150, 150) and sum(r[2] for r in found[:3]) in (150, 300)


def test_stages(spark, docs, none, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, none):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            now.write.parquet(str(tmp_path / f"{name}-{given is none}"))
            now = spark.read.parquet(str(tmp_path / f"{name}-{given is none}"))
            assert name == "bpe" or now.columns == list(corpus_pipeline.COLUMNS)
        assert now.count() == 0 if given is none else now.count() > 0
