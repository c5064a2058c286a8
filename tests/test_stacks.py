"""Images that are worked on in stacks: each gets what it would get alone."""

import numpy as np
import pytest

from lensmill.functions import pixels
from lensmill.operators import vision
from lensmill.plans import queries as q


@pytest.mark.parametrize("shape", [(7, 13), (12, 16, 3), (1, 5)])
def test_stacks_give_what_single_images_give(shape):
    rng = np.random.default_rng(1)
    own = rng.integers(0, 256, (5, *shape), dtype=np.uint8)
    assert np.array_equal(pixels.bilinear_all(own, 31, 9), np.stack([pixels.bilinear(x, 31, 9) for x in own]))
    for how in ({"raw": True}, {}, vision.PLAIN):
        assert np.array_equal(pixels.tensors(own, **how), np.concatenate([pixels.tensor(x, **how) for x in own]))
    quads = [np.array([[0, 0], [6, 1], [6, 5], [0, 6]]) + rng.random((4, 2)) for _ in own]
    assert all(np.array_equal(a, pixels.warp(x, k)) for a, x, k in zip(vision.warped(list(own), quads), own, quads, strict=True))


def test_one_bad_image_of_a_stack():
    """A quad without an area or a finite place fails alone, and the model still sees every other image once."""
    own = np.full((4, 12, 16), 90, np.uint8)
    good = np.array([[0, 0], [15, 0], [15, 11], [0, 11]], float)
    found = vision.warped(list(own), [good, np.full((4, 2), np.nan), good, np.zeros((4, 2))])
    assert [isinstance(x, Exception) for x in found] == [False, True, False, True] and found[2].shape == (11, 15)
    seen = dict(vision._inputs([own[0], own[1, :6], own[2]], 32, pixels.tensors))
    assert sorted(seen) == [0, 1, 2] and all(x.shape == (1, 3, 32, 32) and x.flags.c_contiguous for x in seen.values())


def test_images_are_looked_up(spark):
    """The fixture's images come from a small table, and their pixels are those of the arithmetic."""
    rows = q.images(spark, "/root/testdata/sf0.001").where("event_id % 97 < 3").select("event_id", "data").collect()
    for r in rows[:20]:
        e = r.event_id
        assert bytes(r.data) == bytes((e * 31 + c * 7 + y * 13 + c * y * (e % 5)) % 256 for y in range(12) for c in range(20))
    assert "BroadcastHashJoin" in q.images(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
