import numpy as np
import pytest

from sparkloom.functions import kernels as K
from sparkloom.functions import special
from sparkloom.functions.registration import flow, jacobian, register


def brute_distance(m):
    out = np.zeros(m.shape)
    off = np.argwhere(~m)
    for y, x in np.argwhere(m):
        out[y, x] = np.sqrt(((off - (y, x)) ** 2).sum(1).min()) if len(off) else np.inf
    return out


@pytest.mark.parametrize("seed", range(4))
def test_distance_and_components(seed):
    m = np.random.default_rng(seed).random((13, 17)) < 0.6
    assert np.allclose(K.distance(m), brute_distance(m))
    for eight in (False, True):
        lab = K.components(m, eight)
        assert (lab > 0).sum() == m.sum()
        near = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
        for y, x in np.argwhere(m):
            for dy, dx in near:
                if y + dy < 13 and 0 <= x + dx < 17 and m[y + dy, x + dx]:
                    assert lab[y, x] == lab[y + dy, x + dx]
        # as many labels as flood fills
        left, n = m.copy(), 0
        while left.any():
            n += 1
            todo = [tuple(np.argwhere(left)[0])]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 13 and 0 <= x < 17 and left[y, x]:
                    left[y, x] = False
                    todo += [(y + s * dy, x + s * dx) for dy, dx in near for s in (1, -1)]
        assert lab.max() == n


def test_morphology():
    m = np.zeros((7, 7), bool)
    m[2:5, 2:5] = True
    m[3, 3] = False
    assert K.fill_holes(m).sum() == 9
    assert K.dilate(m, K.footprint("disk", 1)).sum() == 21
    assert K.erode(K.fill_holes(m), K.footprint("box", 1)).sum() == 1
    assert not K.distance(np.zeros((3, 3), bool)).any()
    assert np.isinf(K.distance(np.ones((3, 3), bool))).all()


def test_student_t():
    assert special.t_quantile(0.75, 30) == pytest.approx(0.68275569, abs=1e-7)
    assert special.t_p(1.0, 1.0) == pytest.approx(0.5)
    assert special.t_p(2.0422725, 30) == pytest.approx(0.05, abs=1e-6)
    assert 0 < special.t_p(40.0, 6000) < 1e-300
    assert np.isnan(special.t_p(np.nan, 5))
    assert special.normal_cdf(1.959963985) == pytest.approx(0.975)


def test_registration_lowers_loss_without_folding():
    y, x = np.mgrid[:40, :40]
    a = np.exp(-((y - 18) ** 2 + (x - 18) ** 2) / 50.0)[None]
    b = np.exp(-((y - 21) ** 2 / 60.0 + (x - 20) ** 2 / 40.0))[None]
    f, losses = register(a, b, iterations=40)
    assert losses[-1] < 0.3 * losses[0]
    assert all(q <= p for p, q in zip(losses, losses[1:]))
    assert jacobian(f.maps()[0][-1]).min() > 0
    there = flow(f.v, np.array([18.0]), np.array([18.0]))
    back = flow(f.v, *there, inverse=True)
    assert np.allclose(back, 18, atol=0.3) and there[0][0] > 19


def test_hierarchy_and_smoothers():
    assert K.hierarchy_levels(20, 4) == [5, 10, 15, 20]
    tree = K.ward(np.array([[0, 0], [0, 1], [5, 5], [5, 6], [9, 0]]))
    assert K.cut_tree(tree, 5, 3) == [0, 0, 1, 1, 2]
    line = np.arange(12.0)
    assert np.allclose(K.rw2_smooth(line), line)
    assert K.spline_hat(line).shape == (12, 12)
