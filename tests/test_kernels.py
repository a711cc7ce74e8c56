import numpy as np
import pytest

from vasculyze.operators import kernels as K


def test_mixed_mask_has_two_segments():
    m = np.zeros((64, 64), bool)
    m[12, 5:45] = m[45, 5:35] = True
    m[25:46, 35] = True
    assert len(K.segments(K.thin(m))) == 2


def test_bar_width_and_components():
    m = np.zeros((64, 64), bool)
    m[8:56, 20:28] = True
    assert abs(K.vessel_features(m)["mean_vessel_caliber_px"] - 8) <= 1
    b = np.zeros((12, 12), bool)
    b[1:3, 1:3] = b[8:10, 8:10] = True
    assert K.label(b)[1] == 2 and K.label(np.zeros((5, 5), bool))[1] == 0


def test_y_has_one_junction():
    m = np.zeros((15, 15), bool)
    m[7, 3:12] = True
    for i in range(5):
        m[7 - i, 7 + i] = m[7 + i, 7 + i] = True
    assert K.vessel_features(m)["branchpoint_density"] > 0


def test_fractal_dimension_orders_line_and_grid():
    line, grid = np.zeros((64, 64), bool), np.zeros((64, 64), bool)
    line[32, 8:56] = True
    grid[::4] = grid[:, ::4] = True
    assert 0.8 <= K.fractal_dimension(line) <= 1.2 < K.fractal_dimension(grid) < 2


def test_distance_matches_brute_force():
    m = np.random.default_rng(0).random((12, 15)) > 0.3
    off = np.argwhere(~m)
    want = np.array([[np.sqrt(((off - (r, c)) ** 2).sum(1)).min() if m[r, c] else 0 for c in range(15)] for r in range(12)])
    assert np.allclose(K.distance(m), want)


@pytest.mark.parametrize(("widths", "k", "want"), [([3, 4], 0.88, 4.4), ([5, 12], 0.95, 12.35)])
def test_equivalent_width(widths, k, want):
    assert K.equivalent_width(widths, k) == pytest.approx(want)
    assert K.equivalent_width([], k) is None and K.equivalent_width([1, -1], k) is None
