"""Nearest burned cells on tile lines against all pairs of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perimeter.config import BAND_EDGES
from perimeter.operators import dataset as D
from perimeter.operators import distance as ND


def brute(mask):
    """Squared distance, row and column of the nearest burned cell for every cell; ties to the least row, column."""
    rows, cols = np.nonzero(mask)
    r, c = np.indices(mask.shape)
    d2 = (r[..., None] - rows) ** 2 + (c[..., None] - cols) ** 2
    best = (d2 * mask.size + rows * mask.shape[0] + cols).argmin(axis=-1)
    return np.take_along_axis(d2, best[..., None], -1)[..., 0], rows[best], cols[best]


def masks(patch, n, seed):
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(n):
        share = rng.choice([0.002, 0.02, 0.2, 0.7, 1.0])
        m = rng.random((patch, patch)) < share
        if k % 4 == 0:
            m[:] = False
            m[rng.integers(0, patch), rng.integers(0, patch)] = True
        out[f"t{k}"] = m
    return out | {"empty": np.zeros((patch, patch), bool)}


def burned_cells(spark, tiles):
    rows = [(k, int(r), int(c)) for k, m in tiles.items() for r, c in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows + rows[:20], "sample_id string, r int, c int")


@pytest.mark.parametrize("patch,n", [(1, 1), (5, 12), (16, 24), (33, 12)])
def test_lines_equal_all_pairs(spark, patch, n):
    tiles = masks(patch, n, patch)
    lines = ND.nearest_lines(burned_cells(spark, tiles), ["sample_id"], patch)
    parts = [F.transform("near", lambda x: ND.squared(x, patch)).alias("d2"), F.transform("near", lambda x: ND.row_of(x, patch)).alias("nr"),
             F.transform("near", lambda x: ND.col_of(x, patch)).alias("nc")]
    got = {}
    for row in lines.select("sample_id", "r", *parts).collect():
        got.setdefault(row["sample_id"], {})[row["r"]] = (row["d2"], row["nr"], row["nc"])
    assert set(got) == {k for k, m in tiles.items() if m.any()}
    for k, of in got.items():
        d2, nr, nc = brute(tiles[k])
        assert sorted(of) == list(range(patch))
        for r in range(patch):
            assert of[r] == (d2[r].tolist(), nr[r].tolist(), nc[r].tolist()), (k, r)


def test_band_rates_equal_counts_per_cell(spark):
    patch, rng = 48, np.random.default_rng(9)
    tiles = masks(patch, 12, 3)
    marks, want = [], {}
    for k, m in tiles.items():
        grown = ~m & (rng.random(m.shape) < 0.05)
        marks += [(k, int(r), int(c), False) for r, c in zip(*np.nonzero(m))] + [(k, int(r), int(c), True) for r, c in zip(*np.nonzero(grown))]
        if m.any():
            bands = np.digitize(np.sqrt(brute(m)[0]), BAND_EDGES)
            for b in range(len(BAND_EDGES) + 1):
                here = (bands == b) & ~m
                old = want.get(b, (0, 0))
                want[b] = (old[0] + int(here.sum()), old[1] + int((here & grown).sum()))
    samples = spark.createDataFrame([(k,) for k in tiles], "sample_id string")
    rates = D.base_rates(samples, spark.createDataFrame(marks, "sample_id string, r int, c int, y boolean"), patch)
    assert {r["band"]: (r["n_pixels"], r["n_positive"]) for r in rates.collect()} == want


def test_no_python_worker_and_no_row_per_cell(spark):
    cells = spark.createDataFrame([("s", 0, 0, True, 1.0), ("s", 1, 1, False, 1.0)], "sample_id string, r int, c int, burned boolean, x double")
    plan = D.with_distance(cells, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_packed_tiles_keep_places_of_missing_cells(spark):
    patch, rng = 6, np.random.default_rng(2)
    want, rows = {}, []
    for sample in ("a", "b"):
        for step in (0, 1):
            x = rng.normal(size=(patch, patch)).astype("float32").astype(float)
            x[rng.random((patch, patch)) < 0.3] = 0
            want[sample, step] = x.ravel().tolist()
            rows += [(sample, step, r, c, float(x[r, c]), 7) for r in range(patch) for c in range(patch) if x[r, c] != 0]
    cells = spark.createDataFrame(rows, "sample_id string, step int, r int, c int, u double, fuel_idx int").orderBy(F.rand(1))
    got = D.pack_tiles(cells, ("u", "fuel_idx"), patch).collect()
    assert {(r["sample_id"], r["step"]): list(r["values"]) for r in got if r["channel"] == "u"} == want
    fuel = {(r["sample_id"], r["step"]): list(r["values"]) for r in got if r["channel"] == "fuel_idx"}
    assert fuel == {k: [7.0 if x else 0.0 for x in v] for k, v in want.items()}
