"""Donors by lower bounds are those by all distances."""

import numpy as np
import pytest

from furrow.operators import knn


def plainly(points, ids, asked, k):
    has, out = ~np.isnan(points), []
    for q, row in enumerate(knn._present_distances(asked, points)):
        for f in np.flatnonzero(np.isnan(asked[q])):
            out += [(q, f, i, row[i]) for i in knn._lowest(np.where(has[:, f], row, np.inf), ids, k)]
    return sorted(out)


@pytest.mark.parametrize("offset, scale, gaps", [(0, 1, 0.2), (1e6, 1, 0.2), (0, 1e30, 0.5), (0, 1e-30, 0.95), (0, 1e200, 0.2)])
def test_donors_are_the_nearest(offset, scale, gaps):
    rng = np.random.default_rng(5)
    points = offset + scale * rng.normal(size=(700, 6)).round(1)  # many ties
    points[rng.random(points.shape) < gaps] = np.nan
    points[:650, 5] = np.nan  # donors of a column may be rare
    points[7] = np.nan
    ids = rng.permutation(700)
    found = knn._Donors(points, ids, 4).of(points[:90])
    assert sorted(zip(*(p.tolist() for p in found))) == plainly(points, ids, points[:90], 4)


def test_few_rows_are_measured_whole(monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(4000, 8))
    points[rng.random(points.shape) < 0.1] = np.nan
    whole, plain = [], knn._present_distances
    monkeypatch.setattr(knn, "_present_distances", lambda a, b: whole.append(len(a)) or plain(a, b))
    knn._Donors(points, np.arange(4000), 15).of(points[:200])
    assert sum(whole) < 10
