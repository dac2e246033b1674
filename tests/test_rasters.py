"""Rasters and completeness tests against plain loops."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quakespark.operators import completeness as C
from quakespark.operators import rasters as R
from quakespark.sources.geometry import RING


def field(spark, rows):
    return spark.createDataFrame([(i, j, v) for j, row in enumerate(rows) for i, v in enumerate(row)], "i long, j long, value double")


def test_samples(spark):
    raster = field(spark, [[0.0, 1.0, 2.0], [10.0, None, 12.0], [20.0, 21.0, 22.0]])
    frame = (-70.0, -30.0, 0.5, -0.5)
    points = [(1, -69.75, -30.0), (2, -70.0, -30.25), (3, -69.75, -30.25), (4, -69.0, -31.0), (5, -68.9, -30.0), (6, None, -30.0), (7, -69.5, -30.0), (8, -69.9, -31.0)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    got = {r["id"]: r["value"] for r in R.sampled(df, raster, frame).collect()}
    assert {k: v and round(v, 9) for k, v in got.items()} == {1: 0.5, 2: 5.0, 3: None, 4: 22.0, 5: None, 6: None, 7: 1.0, 8: 20.2}
    near = {r["id"]: r["value"] for r in R.sampled(df, raster, frame, "nearest").collect()}
    assert near[3] == 0.0 and near[5] == 2.0 and near[8] == 20.0 and near[6] is None


def test_smoothing_equals_loops(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(7, 9))
    z[rng.random((7, 9)) < 0.3] = np.nan
    z[0:4, 5:9] = np.nan
    w, sigma = R.gaussian(0.8), 0.8
    radius = len(w) // 2
    assert radius == int(4 * sigma + 0.5) and abs(sum(w) - 1) < 1e-12

    def blurred(a):
        for axis in (0, 1):
            out = np.zeros_like(a)
            for k in range(a.shape[axis]):
                for o in range(-radius, radius + 1):
                    at = min(max(k + o, 0), a.shape[axis] - 1)
                    np.moveaxis(out, axis, 0)[k] += w[o + radius] * np.moveaxis(a, axis, 0)[at]
            a = out
        return a

    num, den = blurred(np.nan_to_num(z)), blurred(np.isfinite(z).astype(float))
    want = np.where(den > 1e-6, num / np.maximum(den, 1e-300), np.nan)
    want[~np.isfinite(z) & (den < 0.5)] = np.nan
    rows = [(i, j, float(z[j, i])) for j in range(7) for i in range(9) if not (j == 6 and not np.isfinite(z[j, i]))]  # unknown nodes may be missing, or not numbers
    got = np.full((7, 9), np.nan)
    for r in R.smoothed(spark.createDataFrame(rows, "i long, j long, value double"), 9, 7, sigma).collect():
        got[r["j"], r["i"]] = np.nan if r["value"] is None else r["value"]
    assert np.allclose(got, want, equal_nan=True)


def test_smoothing_by_blocks(spark):
    """Lines longer than a block, with whole blocks unknown or missing, against one pass over whole lines; no row holds a whole line."""
    high, w = 3 * R.BLOCK + 5, R.gaussian(1.5)
    radius = len(w) // 2
    known = {(i, j): float((i * 7 + j * 13) % 29) for i in (0, 2) for j in range(high) if not R.BLOCK - 20 < j < 2 * R.BLOCK + 20 or i == 2 and j == R.BLOCK}
    raster = spark.createDataFrame([(*k, v) for k, v in known.items()], "i long, j long, value double")
    z = np.zeros((2, high, 3))
    for (i, j), v in known.items():
        z[:, j, i] = v, 1.0
    down = sum(w[o + radius] * z[:, np.clip(np.arange(high) + o, 0, high - 1)] for o in range(-radius, radius + 1))
    v, k = sum(w[o + radius] * down[:, :, np.clip(np.arange(3) + o, 0, 2)] for o in range(-radius, radius + 1))
    got = {(r["i"], r["j"]): r["value"] for r in R.smoothed(raster, 3, high, 1.5).collect()}
    assert len(got) == 3 * high
    for (i, j), value in got.items():
        want = v[j, i] / k[j, i] if k[j, i] > 1e-6 and ((i, j) in known or k[j, i] >= 0.5) else None
        assert (value is None) == (want is None) and (want is None or abs(value - want) < 1e-9), (i, j)
    known_rows = raster.select("i", "j", F.col("value").alias("v"), F.lit(1.0).alias("k"))
    assert R._blocks(known_rows, "j", "i", high, radius).agg(F.max(F.size("line"))).first()[0] <= R.BLOCK + 2 * radius


def test_masks_and_boxes(spark):
    raster, frame = field(spark, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), (0.0, 0.0, 1.0, 1.0)
    polygons = spark.createDataFrame([(1, [[(0.5, -0.5), (2.5, -0.5), (2.5, 0.5), (0.5, 0.5)]])], f"poly long, rings {RING}")
    assert {(r["i"], r["j"]): r["value"] for r in R.masked(raster, polygons, frame).collect()} == {(0, 0): None, (1, 0): 2.0, (2, 0): 3.0, (0, 1): None, (1, 1): None, (2, 1): None}
    assert {r["value"] for r in R.masked(raster, polygons, frame, crop=True).collect()} == {2.0, 3.0}
    assert {r["value"] for r in R.boxed(raster, (0.0, 1.0, 1.0, -1.0), 0.5, -0.5, 2.0, 0.5).collect()} == {5.0, 6.0}
    assert abs(R.pixel_km((0.0, 0.0, 1.0, 1.0), 1) - 111.32) < 1e-9


def test_ks_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    mags = np.round((4.0 + rng.exponential(1 / math.log(10), 900)) / 0.1) * 0.1
    mags = mags[(mags > 4.45) | (rng.random(len(mags)) < 0.3)]
    events = spark.createDataFrame([(float(m), "a") for m in mags] + [(5.0, "few")] * 3 + [(None, "a"), (4.0, None)], "mag double, cls string")
    bins = C.magnitude_bins(events, events["cls"])
    table = {(r["key"], r["bin"]): r for r in C.ks_table(bins, draws=300, least=30, seed=2).collect()}
    k = np.round(mags / 0.1).astype(int)
    for first in range(k.min(), k.max() + 1):
        n = int((k >= first).sum())
        if n < 30:
            assert ("a", first) not in table
            continue
        size = k.max() - first + 1
        law = [1 - 10 ** (-0.1 * (x + 1)) for x in range(size)]
        far = lambda counts: max(abs(sum(counts[: x + 1]) / n - law[x]) for x in range(size))  # noqa: B023, E731
        own = far([int((k == first + x).sum()) for x in range(size)])
        draws = np.random.default_rng([2, zlib.crc32(b"a"), first])
        parts = [b - a for a, b in zip([0.0, *law[:-1]], law, strict=True)] + [1 - law[-1]]
        sample = draws.multinomial(n, parts, size=300)
        p = sum(far(list(s[:-1])) >= own - 1e-12 for s in sample) / 300
        r = table["a", first]
        assert r["n"] == n and abs(r["distance"] - own) < 1e-9 and abs(r["p"] - p) <= 0.011
    assert {key for key, _ in table} == {"a"}
    found = {r["key"]: r for r in C.mc_by_ks(bins, draws=300, least=30, seed=2).collect()}
    assert 4.4 <= found["a"]["mc"] <= 4.6 and (found["few"]["mc"], found["few"]["n_events"]) == (None, 3)


def test_windows_and_stamps(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(np.round((low + rng.exponential(1 / math.log(10))) / 0.1) * 0.1), year, "a") for i, (low, year) in enumerate([(5.0, 1910.0)] * 300 + [(4.0, 1950.0)] * 300 + [(4.5, 1970.0)] * 300)]
    rows += [(9000, 9.0, 1950.0, "other"), (9001, None, 1800.0, "a")]
    events = spark.createDataFrame(rows, "id long, mag double, yr double, cls string")
    windows = [(1900.0, 1930.0), (1930.0, 1960.0), (1955.0, 2000.0), (2000.0, 2010.0)]
    table = C.mc_windows(events, windows, ["a"], draws=300)
    got = {r["window"]: r for r in table.collect()}
    assert [got[w]["n_events"] for w in range(4)] == [300, 300, 300, 0] and got[2]["raw_mc"] > got[1]["mc"] and got[2]["mc"] == got[1]["mc"] and got[3]["mc"] is None
    stamps = {r["id"]: (r["window"], r["mc"], r["years"]) for r in C.stamped(events, table, windows).collect()}
    assert stamps[0] == (0, got[0]["mc"], 30.0) and stamps[9000] == (1, got[1]["mc"], 30.0) and stamps[9001] == (-1, None, None)
