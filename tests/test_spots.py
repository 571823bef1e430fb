"""Spots chosen in rounds against the greedy loop."""

import math
import random

import pytest

from cairn.operators import raster


def greedy(cells, cell, count, separation, least):
    """The loop over all candidates, best first."""
    block, best = max(1, int(10 / cell + 0.5)), {}
    for r, c, s in cells:
        if s is not None:
            key = (r // block, c // block)
            best[key] = max(best.get(key, (-math.inf, 0, 0)), (s, -r, -c))
    out = []
    for s, r, c, _ in sorted(((s, -r, -c, k) for k, (s, r, c) in best.items() if s >= least), key=lambda x: (-x[0], x[3])):
        if len(out) < count and all(math.hypot((r - a) * cell, (c - b) * cell) >= separation for _, a, b, _ in out):
            out.append((len(out) + 1, r, c, s))
    return out


@pytest.mark.parametrize(("cell", "count", "separation", "least"), [(2.0, 3, 40.0, 0.2), (2.0, 1, 40.0, 0.0), (5.0, 500, 60.0, 0.1), (10.0, 7, 0.0, 0.5), (1.0, 20, 30.0, 0.9), (2.0, 4, 1e6, 0.0), (10.0, 40, 25.0, 0.0)])
def test_equals_the_greedy_loop(spark, cell, count, separation, least):
    rng = random.Random(count)
    grids = {g: [(r, c, rng.choice([None, rng.random(), rng.randrange(4) / 4, 0.5])) for r in range(40) for c in range(35)] for g in (0, 1)}
    grids[2] = [(r, c, 0.7) for r in range(30) for c in range(30)]  # ties throughout
    grids[3] = [(0, 0, 0.01), (1, 1, None)]
    grids[4] = [(r, 0, r / 60) for r in range(60)]  # a slope, which is chosen from one end
    rows = [(g, *x) for g, cells in grids.items() for x in cells]
    df = spark.createDataFrame(rows, "grid int, row int, col int, score double")
    got = raster.pick_spots(df, cell=cell, count=count, separation=separation, least=least, grid=("grid",)).collect()
    assert sorted(map(tuple, got)) == sorted((g, *x) for g, cells in grids.items() for x in greedy(cells, cell, count, separation, least))
    if count == 3:
        one = raster.pick_spots(df.filter("grid = 1").drop("grid"), cell=cell, count=count, separation=separation, least=least).collect()
        assert sorted(map(tuple, one)) == greedy(grids[1], cell, count, separation, least)


def test_no_cells(spark):
    assert raster.pick_spots(spark.createDataFrame([], "grid int, row int, col int, score double"), grid=("grid",)).collect() == []


def test_no_python_and_no_grid_in_one_task(spark):
    df = spark.createDataFrame([(0, r, c, float(r * c % 7) / 7) for r in range(30) for c in range(30)], "grid int, row int, col int, score double")
    plan = raster.pick_spots(df, grid=("grid",))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
