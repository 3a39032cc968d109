"""Image kernels against plain loops and planted truths."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.functions import kernels as K
from frameloom.operators import images as I

RNG = np.random.default_rng(5)


def test_upper_median_and_pick():
    assert [K.upper_median(np.arange(n, dtype=float)) for n in (1, 2, 3, 4)] == [0, 1, 1, 2]
    assert K.upper_median(np.zeros(0)) == 0.0
    assert K.pick(np.arange(10.0), 0.999) == 9.0


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 4))
def test_box_blur_is_a_mean_of_means(h, w, r):
    a = np.random.default_rng(h * 100 + w).normal(size=(h, w))
    rows = np.array([[a[y, max(x - r, 0) : x + r + 1].mean() for x in range(w)] for y in range(h)])
    want = np.array([[rows[max(y - r, 0) : y + r + 1, x].mean() for x in range(w)] for y in range(h)])
    np.testing.assert_allclose(K.box_blur(a, r), want, atol=1e-12)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**30))
def test_label_and_dilate(seed):
    mask = np.random.default_rng(seed).random((7, 9)) < 0.5
    seen, n = -np.ones(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x] >= 0:
            continue
        todo, n = [(y, x)], y * 9 + x
        while todo:
            j, i = todo.pop()
            if 0 <= j < 7 and 0 <= i < 9 and mask[j, i] and seen[j, i] < 0:
                seen[j, i] = n
                todo += [(j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)]
    assert (K.label(mask) == seen).all()
    want = np.array([[mask[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].any() for x in range(9)] for y in range(7)])
    assert (K.dilate(mask, 1) == want).all()
    assert not (K.drop_small(mask, 3) & ~mask).any()


@pytest.mark.parametrize("pattern", sorted(K.CFA))
def test_demosaic_recovers_a_constant_colour(pattern):
    masks = K.cfa_masks(pattern, 6, 8)
    mosaic = sum(m * v for m, v in zip(masks, (0.2, 0.5, 0.9), strict=True))
    np.testing.assert_allclose(K.demosaic(mosaic, pattern), np.broadcast_to([0.2, 0.5, 0.9], (6, 8, 3)))


def test_unknown_pattern_is_refused():
    with pytest.raises(ValueError):
        K.cfa_masks("XTRN", 4, 4)


def test_stars_are_found_at_sub_pixel_places():
    y, x = np.mgrid[:60, :80]
    truth = [(20.3, 15.6, 5.0), (50.2, 40.4, 3.0)]
    sky = 0.1 + RNG.normal(0, 1e-3, (60, 80))
    for sx, sy, f in truth:
        sky += f * np.exp(-((x - sx) ** 2 + (y - sy) ** 2) / 2)
    found = K.detect_stars(sky, 2, stride=7)
    for (sx, sy, _), got in zip(truth, found, strict=True):
        assert np.hypot(got[0] - sx, got[1] - sy) < 0.2
    assert len(K.detect_stars(np.zeros((3, 3)), 5)) == 0


def test_warp_by_whole_pixels_and_coverage():
    a = RNG.random((10, 12))
    out, inside = K.warp(a, (1.0, 0.0, 2.0, 1.0))
    np.testing.assert_allclose(out[:8, :9], a[1:9, 2:11])
    assert not inside[-1].any() and not inside[:, -1].any()
    cells = np.zeros((2, 3), dtype=bool)
    cells[0, 0] = True
    masked = K.warp_mask(cells, 4, (10, 12), (1.0, 0.0, 0.0, 0.0))
    assert masked[:4, :4].all() and not masked[5:9, 5:11].any()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**30))
def test_largest_rectangle(seed):
    full = np.random.default_rng(seed).random((5, 6)) < 0.7
    best = max(((y1 - y0) * (x1 - x0) for y0 in range(5) for y1 in range(y0 + 1, 6) for x0 in range(6) for x1 in range(x0 + 1, 7) if full[y0:y1, x0:x1].all()), default=0)
    x0, y0, x1, y1 = K.largest_rectangle(full)
    if best:
        assert full[y0:y1, x0:x1].all() and (y1 - y0) * (x1 - x0) == best


def test_drift_between_shifted_frames():
    base = K.box_blur(RNG.random((600, 640)), 3)
    cells = np.zeros((18, 20), dtype=bool)
    cells[9:] = True
    moved = np.roll(base, (6, -4), (0, 1))
    dx, dy, ncc = K.drift(base, moved, cells, 32, 32)
    assert abs(dx + 4) < 1 and abs(dy - 6) < 1 and ncc > 0.5
    assert K.drift(base, moved, np.zeros_like(cells), 32, 32) is None


def test_trimmed_mean_drops_a_trail_and_keeps_masked_pixels():
    frames = {k: np.full((8, 8), 1.0) for k in range(5)}
    frames[2][4] = 9.0
    masks = {k: np.zeros((8, 8), dtype=bool) for k in range(5)}
    masks[2][0] = True
    still = {k: (1.0, 0.0, 0.0, 0.0) for k in range(5)}
    out, used = I.combine_warped(frames, masks, still, 2)
    assert out[4, 3] == 1.0 and used[4, 3] == 5
    assert used[0, 0] == 1
    few, _ = I.combine_warped({2: frames[2], 3: frames[3]}, masks, still, 2)
    assert few[4, 3] == 5.0


def test_occlusion_keeps_hidden_stars_hidden():
    combined = RNG.normal(0.1, 1e-4, (256, 256, 3))
    combined[::16, ::16] += 1.0
    current = combined.copy()
    current[:, :128] = 0.1
    out, area = K.keep_occlusions(current, combined, np.zeros((256, 256), dtype=bool))
    assert 0.1 < area < 0.9
    assert out[128, 32].max() < 0.6 and out[128, 224].max() > 0.9


def test_transients_are_long_thin_regions():
    combined = RNG.normal(0.5, 1e-3, (120, 160, 3))
    current = combined.copy()
    current[60, 20:90] += 0.2
    current[100, 100] += 0.9
    mask = K.transient_mask(current, combined, np.zeros((120, 160), dtype=bool))
    assert mask[60, 30:80].all() and not mask[100, 100]
    assert not K.transient_mask(current, combined, np.zeros((120, 160), dtype=bool), np.ones((120, 160))).any()


def test_level_stats_are_plain_on_a_flat_image():
    s = K.level_stats(np.full((20, 20, 3), 0.4))
    np.testing.assert_allclose(s, 0.4)
    assert (K.level_stats(np.zeros((4, 4, 1)), np.ones((4, 4), dtype=bool)) == 0).all()


def test_removed_layer_is_the_mean_correction_about_the_pedestal():
    class Flat:
        def correction(self, x, y):
            return 0.1 + 0.0 * x

    grid = I.mean_correction(Flat(), np.array([[1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 5.0, 0.0]]), 64, 48)
    np.testing.assert_allclose(I.removed_layer(grid, 0.2, 3, 4, 20, 10), 0.3)
