"""Outlines of masks, their corners, and what counts as a document or a line of text."""

import numpy as np
import pytest

from lensmill.functions import pixels


def mask(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


def test_outline_walks_around():
    assert pixels.outline(mask("##", "##")).tolist() == [[0, 0], [1, 0], [1, 1], [0, 1]]
    assert pixels.outline(mask("#")).tolist() == [[0, 0]]
    assert pixels.outline(mask("###")).tolist() == [[0, 0], [1, 0], [2, 0], [1, 0]]
    bent = pixels.outline(mask("..##", ".#..", "#..."))  # diagonal neighbours are one region, walked there and back
    assert pixels.polygon_area(bent) == 0 and len(bent) == 6
    both = pixels.outlines(mask("#####", "#...#", "#...#", "#####"))
    assert [pixels.polygon_area(x) for x in both] == [12, 10]  # around a hole the corner pixels touch it only diagonally
    assert len(pixels.outlines(mask("####", "#..#", "##.#", "#..#"))) == 1  # open to the frame: no hole
    assert len(pixels.outlines(mask("####", "#.##", "##.#", "####"))) == 3  # background joins by sides alone: two holes
    assert pixels.outlines(np.zeros((3, 3), bool)) == []


@pytest.mark.parametrize("seed", range(6))
def test_area_by_picks_formula(seed):
    """The area inside an outline follows from the pixels inside and on it."""
    rng = np.random.default_rng(seed)
    own = np.zeros((24, 24), bool)
    for _ in range(5):
        y, x = rng.integers(2, 14, 2)
        own[y : y + rng.integers(3, 9), x : x + rng.integers(3, 9)] = True
    for line in pixels.outlines(own, holes=False):
        filled = np.zeros_like(own)
        filled[line[:, 1], line[:, 0]] = True
        assert (own[line[:, 1], line[:, 0]]).all()
        steps = np.abs(np.diff(np.concatenate([line, line[:1]]), axis=0))
        assert steps.max() == 1
        assert pixels.polygon_area(line) <= np.prod(np.ptp(line, axis=0))
    assert sum(pixels.polygon_area(x) for x in pixels.outlines(own, holes=False)) <= own.sum()


def test_corners():
    square = pixels.outline(np.ones((40, 60), bool))
    assert sorted(pixels.simplified(square).tolist()) == [[0, 0], [0, 39], [59, 0], [59, 39]]
    assert pixels.is_convex(pixels.simplified(square)) and not pixels.is_convex(np.array([[0, 0], [10, 0], [3, 3], [0, 10]]))
    corner = np.ones((60, 60), bool)
    corner[20:, 20:] = False
    assert len(pixels.simplified(pixels.outline(corner))) == 6


def scene(*boxes, shape=(120, 160)):
    out = np.full(shape, 20, np.uint8)
    for y0, y1, x0, x1, v in boxes:
        out[y0:y1, x0:x1] = v
    return out


def test_documents():
    quad, confidence = pixels.contour_quad(scene((20, 100, 30, 130, 230)))
    assert np.abs(quad - [[30, 20], [130, 20], [130, 100], [30, 100]]).max() <= 3 and confidence > 0.8
    u = scene((20, 100, 30, 130, 230), (20, 75, 60, 100, 20))
    assert pixels.contour_quad(u) is None  # its hull is a rectangle, its outline is not
    assert pixels.contour_quad(u, "ios") is None
    hand = scene((20, 100, 30, 130, 230), (60, 80, 131, 160, 230))
    hand[60:80, 128:132] = 20  # something bright right beside the document: its edges touch those of the document
    assert pixels.contour_quad(hand) is not None
    assert pixels.contour_quad(scene((50, 60, 50, 60, 230))) is None


def test_lines_of_text():
    prob = np.zeros((40, 80))
    prob[5:11, 5:45] = 1
    prob[20, 5:45] = 1  # one pixel high: no area
    prob[30:33, 5:9] = 1  # area of its outline: 6
    assert len(pixels.text_boxes(prob, 1, 1)) == 1 and len(pixels.text_boxes(prob, 1, 1, "ios")) == 1
    assert len(pixels.text_boxes(prob, 0.5, 0.5, "ios")) == 2  # sides count as they are in the photo
    ring = np.zeros((40, 80))
    ring[5:30, 5:60] = 1
    ring[10:25, 10:55] = 0
    assert len(pixels.text_boxes(ring, 1, 1)) == 1 and len(pixels.text_boxes(ring, 1, 1, "ios")) == 2
