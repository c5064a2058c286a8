"""The pipeline's mixing stage follows the schedules: every copy at its own position, rows in that order."""

import corpus_pipeline
from lensmill.llm import mixing

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def area(knots, until):
    """The integral of a piecewise linear schedule from 0 to until."""
    total = 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        d = min(max(until - t0, 0.0), t1 - t0)
        total += d * w0 + (w1 - w0) / (t1 - t0) * d * d / 2
    return total


def test_positions(spark, tmp_path):
    rows = [(i, f"d{i} " * (3 + i % 5), "en", "abc"[i % 3], 1) for i in range(90)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = mixing.apply(docs, position_col="position").collect()
    at = [r.position for r in out]
    assert at == sorted(at) and 0 < at[0] and at[-1] < 1
    first = {r.doc_id: r for r in mixing.mix(docs).collect()}
    seen = {}
    for r in out:
        seen.setdefault(r.doc_id, []).append(r.position)
    assert {i: len(p) for i, p in seen.items()} == {i: r.copies for i, r in first.items() if r.copies}
    assert max(map(len, seen.values())) > 1
    for i, own in seen.items():
        r, knots = first[i], mixing.SCHEDULES["abc".index(first[i].source)]
        asked = [area(knots, p) / area(knots, 1.0) * r.target for p in own]
        assert abs(own[0] - r.position) < 1e-9
        assert all(abs(b - a - r.source_size) < 1e-6 * r.target for a, b in zip(asked, asked[1:], strict=False))
    stage = [r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()]
    assert stage == [r.doc_id for r in out]
    turned = mixing.apply(docs, schedules=mixing.SCHEDULES[::-1], position_col="position").collect()
    assert [r.doc_id for r in turned] != stage
