"""Sub-catalogs, trimmed bins, fits and conservation on rows that take each rule."""

import math

from quakespark.operators import selection as S
from quakespark.sources.geometry import RING


def test_sub_catalog(spark):
    rows = [(1, 5.0, 10.0, -70.0, -30.0, 2000.0), (2, 6.0, 10.0, -70.0, -30.0, 2000.0), (3, 5.0, None, -70.0, -30.0, 2000.0), (4, 5.0, 50.0, -70.0, -30.0, 2000.0), (5, 5.0, 10.0, -69.0, -30.0, 2000.0), (6, None, 10.0, -70.0, -30.0, 2000.0), (7, 5.0, 10.0, -70.0, -30.0, 2010.0)]
    events = spark.createDataFrame(rows, "id long, mag double, depth double, lon double, lat double, yr double")
    ids = lambda **k: {r["id"] for r in S.sub_catalog(events, **k).collect()}
    assert ids() == set(range(1, 8)) and ids(mag=(5.0, 6.0)) == {1, 3, 4, 5, 7}
    assert ids(depth=(10.0, 50.0)) == {1, 2, 5, 6, 7} and ids(depth=(10.0, 50.0), unknown_depths=True) == {1, 2, 3, 5, 6, 7}
    assert ids(box=(-70.0, -30.0, -69.5, -20.0), years=(2000.0, 2010.0)) == {1, 2, 3, 4, 6}
    square = spark.createDataFrame([(1, [[(-70.5, -30.5), (-69.5, -30.5), (-69.5, -29.5), (-70.5, -29.5)]])], f"poly long, rings {RING}")
    assert ids(polygons=square) == {1, 2, 3, 4, 6, 7} and S.sub_catalog(events, polygons=square).columns == events.columns


def test_trimmed_bins_and_nodes(spark):
    rates = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0), (1, 2, 0.0), (2, 0, 0.0), (3, 0, 1.0), (4, 0, 1.0), (5, 0, 1.0)], "cell long, bin int, rate double")
    depths = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 10.0), (3, None, 10.0), (4, 10.0, 10.0)], "cell long, upper double, lower double")
    assert sorted(tuple(r) for r in S.trimmed_bins(rates, depths).collect()) == [(1, 0, 0.0), (1, 1, 2.0)]
    grid = lambda *rows: spark.createDataFrame(list(rows), "lon double, lat double, value double")
    found = S.slab_nodes(grid((1.0, 1.0, -20.0), (2.0, 1.0, -30.0)), grid((1.0, 1.0, -10.0), (2.0, 1.0, None)), grid((1.0, 1.0, 5.0), (2.0, 1.0, 6.0)))
    assert [tuple(r) for r in found.collect()] == [(1.0, 1.0, 20.0, 350.0, 5.0)]


def test_fits_and_comparisons(spark):
    bins = spark.createDataFrame([("a", m / 10, 10 ** (4 - m / 10)) for m in range(40, 60)] + [("a", 9.0, 0.0), ("one", 5.0, 1.0)], "key string, m double, rate double")
    got = {r["key"]: r for r in S.least_squares(bins, "key", 0.1).collect()}
    a = got["a"]
    assert a["n_bins"] == 20 and abs(a["a"] - 4) < 1e-9 and abs(a["b"] - 1) < 1e-9 and abs(a["r2"] - 1) < 1e-9 and a["rms"] < 1e-6
    assert tuple(got["one"])[1:] == (1, None, None, None, None)
    model = lambda *rows: spark.createDataFrame(list(rows), "fault long, rate double")
    rows = {r["fault"]: tuple(r)[3:] for r in S.compared(model((1, 1.0), (2, 1.0), (4, 0.0)), model((1, 10.0), (3, 1.0), (4, 1.0)), "fault").collect()}
    assert rows == {1: (1.0, None), 2: (None, "first"), 3: (None, "second"), 4: (None, None)}


def test_conservation(spark):
    before = spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0), (1, 1, 1.0), (2, 1, 1.0)], "cell long, bin int, rate double")
    after = spark.createDataFrame([(1, 0, 0.5, True), (2, 0, 3.0, False), (1, 1, 1.0, True), (2, 1, 1.1, False)], "cell long, bin int, rate double, inside boolean")
    good, bad = S.conservation(before, after).orderBy("bin").collect()
    assert (good["before"], good["after"], good["moved"], good["outside_change"], good["kept"]) == (5.0, 3.5, 1.5, 0.0, True)
    assert not bad["kept"] and math.isclose(bad["outside_change"], 0.1)
