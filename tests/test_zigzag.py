"""The zigzag in blocks against the state machine over whole symbols."""

import datetime
import random

import pytest

from tidemark.operators import waves, zigzag


def walks(seed, n):
    """Random walks, slow slides with small ripples, flat stretches and ties."""
    rng = random.Random(seed)
    kind, c, out = seed % 4, 100.0, []
    for i in range(n):
        c *= 1 + (rng.gauss(0, 0.02) if kind == 0 else rng.choice([-0.004, 0.003]) if kind == 1 else 0.0 if rng.random() < 0.7 else rng.gauss(0, 0.05) if kind == 2 else rng.choice([-0.05, 0.05]))
        out.append(round(c, 2) if kind < 3 else float(round(c)))
    return out


@pytest.mark.parametrize("pct", [0.0, 1.0, 5.0, 12.0])
def test_blocks_compose(pct):
    """Followed by summaries alone, every block is entered and left in the state of
    the whole run, and the turns are those of the whole run."""
    for seed in range(60):
        close, rng = walks(seed, 150), random.Random(seed)
        cuts = sorted({0, *(rng.randrange(1, 150) for _ in range(rng.randrange(12)))}) + [150]
        s = t = zigzag.State(0, close[0], 0, close[0], 0)
        found = [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = close[a:b]
            found += zigzag.turns(t, a, part, pct / 100)
            names = [c.split()[0] for c in zigzag.COLUMNS.split(", ")]
            row = type("Row", (), dict(zip(names, zigzag.summary(a, part, pct / 100), strict=True)))
            for i, c in enumerate(part, a):
                s, _ = zigzag.step(s, i, c, pct / 100)
            t = zigzag.leave(t, row, pct / 100)
            assert repr(t) == repr(s)
        assert list(dict.fromkeys([*found, 149])) == waves.pivots(close, pct)


def test_waves_in_blocks(spark):
    """Equal to the grouped machine in every column, whatever the size of blocks; a
    symbol of one bar has no wave."""
    start = datetime.date(2000, 1, 1)
    rows = [(f"s{k}", start + datetime.timedelta(days=i), c, None if i % 17 == 0 else i) for k in range(6) for i, c in enumerate(walks(k, 400 + 50 * k))]
    bars = spark.createDataFrame([*rows, ("one", start, 5.0, 1)], "symbol string, date date, close double, volume long").repartition(5)
    for settings in ((5.0, 3.5, 22), (2.0, 3.5, 2**31 - 1)):
        want = sorted(map(tuple, waves.waves(bars, *settings).collect()))
        for size in (7, 100, 10**6):
            got = sorted(map(tuple, zigzag.waves_in_blocks(bars, *settings, rows=size).collect()))
            assert got == want and len(want) > 20
    assert {w[2] for w in map(tuple, waves.waves(bars).collect())} == {"up", "down", "range"}
    assert zigzag.waves_in_blocks(bars.limit(0)).count() == 0
