"""Feature picks against a plain loop over the same rules."""

import numpy as np
import pandas as pd
import pytest

from scanlake.operators.selection import label_scan, label_scans


def loop(pdf, edge, flat, sharp, gap):
    n = len(pdf)
    c = pdf["curvature"].fillna(0.0).to_numpy()
    col = pdf["col"].to_numpy()
    taken = pdf["blocked"].to_numpy().copy()
    label = np.zeros(n, int)

    def suppress(i):
        taken[i] = True
        for step in (1, -1):
            for far in range(1, 6):
                j = i + step * far
                if not 0 <= j < n or abs(col[j] - col[j - step]) > gap:
                    break
                taken[j] = True

    for sp, ep in pdf.loc[pdf["sp"].notna(), ["sp", "ep"]].drop_duplicates().sort_values("sp").to_numpy().astype(int):
        order = sorted(range(sp, ep), key=lambda i: (c[i], i)) + [ep]
        count = 0
        for i in reversed(order):
            if not taken[i] and c[i] > edge:
                count += 1
                if count > sharp:
                    break
                label[i] = 1
                suppress(i)
        for i in order:
            if not taken[i] and c[i] < flat:
                label[i] = -1
                suppress(i)
    return label


@pytest.mark.parametrize("seed", range(6))
def test_picks_match_the_loop(seed):
    rng = np.random.default_rng(seed)
    n = 240
    pdf = pd.DataFrame({
        "scan_id": 1, "idx": np.arange(n), "ring": np.arange(n) // 60,
        "col": np.concatenate([np.sort(rng.choice(400, 60, replace=False)) for _ in range(4)]),
        "curvature": rng.choice([0.05, 0.2, 0.5, np.nan], n) * rng.random(n), "blocked": rng.random(n) < 0.1,
        "x": 0.0, "y": 0.0, "z": 0.0, "sp": np.nan, "ep": np.nan, "in_sector": False,
    })
    for ring in range(4):
        for k in range(4):
            sp, ep = ring * 60 + 5 + k * 12, ring * 60 + 5 + k * 12 + 11
            pdf.loc[sp:ep, ["sp", "ep"]] = [sp, ep]
            pdf.loc[sp:ep, "in_sector"] = True
    got = label_scan(pdf.sample(frac=1, random_state=1), 0.1, 0.1, 0, 3, None, 10, 0.0, False)
    assert list(got.sort_values("idx")["label"]) == list(loop(pdf, 0.1, 0.1, 3, 10))


def test_many_scans_at_once_equal_one_by_one():
    """Scans behind each other are labelled in one call; a pick blocks nothing of the next scan."""
    rng = np.random.default_rng(9)
    sizes = [40, 7, 90, 25]
    starts = np.cumsum([0, *sizes[:-1]])
    n = sum(sizes)
    idx = np.concatenate([np.arange(s) + 3 for s in sizes])
    sp = np.where((idx - 3) // 12 * 12 + 11 < np.repeat(sizes, sizes), (idx - 3) // 12 * 12 + 3.0, np.nan)
    columns = [idx, rng.choice([0.05, 0.2, 0.5, np.nan], n) * rng.random(n), rng.random(n) < 0.1, rng.random(n) < 0.1, sp, sp + 11]
    together = label_scans(starts, *columns, 0.1, 0.1, 1, 3, 4, True)
    for a, b in zip(starts, [*starts[1:], n]):
        alone = label_scans(np.zeros(1, np.int64), *[c[a:b] for c in columns], 0.1, 0.1, 1, 3, 4, True)
        assert (together[a:b] == alone).all()
    assert set(together.tolist()) == {-1, 0, 1, 2}
