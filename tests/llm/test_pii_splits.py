"""Split search tries the whole range of a feature."""

import numpy as np

from foldwise.llm import pii


def test_a_cut_above_the_64th_value_is_found():
    x = np.arange(200.0)[:, None]
    y = (x[:, 0] >= 150).astype(float)
    tree = pii._grow(x, 0.5 - y, np.full(200, 0.25), 1)
    assert tree[:2] == (0, 150.0)
