"""The fusion filter on many short runs at once."""

import numpy as np

from scanlake.operators.fusion import FuseOptions, fuse_fold


def test_fusing_many_short_runs_equals_one_by_one():
    fold = fuse_fold(FuseOptions())
    assert fold.many is not None
    rng = np.random.default_rng(4)
    n = 60
    rows = rng.standard_normal((n, 20)) * 0.3
    rows[:, 18], rows[:, 19] = 0.05 + rng.random(n), 1 + rng.random(n)
    rows[rng.random(n) < 0.2, 18] = np.nan
    rows[rng.random(n) < 0.4, 12:18] = np.nan
    starts = np.array([0, 1, 9, 30, 31])
    _, entering = fold.run(np.arange(5.0), rows[:5], None)
    states = [None, entering, None, entering, None]
    out, after = fold.many(np.arange(float(n)), rows, starts, states)
    for begin, end, state, left in zip(starts, [*starts[1:], n], states, after):
        alone, leaving = fold.run(np.arange(float(n))[begin:end], rows[begin:end], state)
        assert np.allclose(out[begin:end], alone, rtol=0, atol=1e-9) and np.allclose(left, leaving, rtol=0, atol=1e-9)
