"""The cells that questions visit go out in frames of bounded size."""

import numpy as np
import pandas as pd

from furrow.operators import knn


def test_visits_come_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(knn, "VISIT_ROWS", 100)
    rng = np.random.default_rng(3)
    needed = rng.random((57, 40)) < 0.5
    needed[:3], needed[10], needed[-1] = False, True, False
    asked = pd.DataFrame({"qkey": [f"q{i}" for i in range(57)], "vector": [np.full(2, float(i)) for i in range(57)]})
    reach = np.arange(57) / 2
    frames = list(knn._visits(asked, needed, reach))
    assert len(frames) > 5 and max(map(len, frames)) <= 100
    got = pd.concat(frames)
    rows, cells = np.nonzero(needed)
    assert got["qkey"].tolist() == [f"q{i}" for i in rows] and got["cell"].tolist() == cells.tolist()
    assert got["bound"].tolist() == reach[rows].tolist() and [v[0] for v in got["vector"]] == rows.tolist()
    monkeypatch.setattr(knn, "VISIT_ROWS", 7)
    assert max(map(len, knn._visits(asked, needed, reach))) == 40  # one question's cells stay together
