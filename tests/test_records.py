"""Records, spectra, geometry and result files, written and read back."""

import json

from quakespark.sources import records


def written(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_accelerations(spark, tmp_path):
    path = written(tmp_path, "a.at2", "PEER\r\nchile\r\nACCEL IN G\r\nNPTS=  5, DT= .0050 SEC\r\n 1.0E-1 -.2\r\n 3d0 4 5 6\r\n")
    r = records.read_accelerations(spark, path).first()
    assert (r["dt"], r["npts"], r["samples"]) == (0.005, 5, [0.1, -0.2, 3.0, 4.0, 5.0])
    assert records.read_accelerations(spark, path, dt=0.5).first()["dt"] == 0.5
    assert records.read_accelerations(spark, written(tmp_path, "b.at2", "no header\n1 2 3\n")).count() == 0


def test_smc(spark, tmp_path):
    ints = [0] * 48
    ints[15], ints[16] = 1, 10
    reals = [1.7e38, 200.0] + [0.0] * 48
    lines = ["text"] * 11 + ["".join(f"{v:10d}" for v in ints[i : i + 8]) for i in range(0, 48, 8)] + ["".join(f"{v:15.7E}" for v in reals[i : i + 5]) for i in range(0, 50, 5)]
    samples = [f"{v / 8:10.4f}" for v in range(-5, 5)]
    body = ["| comment 1 2 3", "".join(samples[:8]), "".join(samples[8:])]
    r = records.read_smc(spark, written(tmp_path, "a.smc", "\n".join(lines + body) + "\n")).first()
    assert (r["dt"], r["npts"]) == (0.005, 10) and r["samples"] == [float(s) for s in samples]
    assert records.read_smc(spark, written(tmp_path, "short.smc", "\n".join(lines + body[:2]))).count() == 0


def test_spectrum_and_edges(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 0, "PGA", 0.25), ("a b", 1, "SA(0.2)", 1.5e-3), ("c", 0, "PGV", 1.0)], "place string, nth int, label string, value double")
    records.write_spectra(rows, str(tmp_path / "uhs"))
    back = records.read_spectrum(spark, str(tmp_path / "uhs" / "*"))
    assert sorted((r["period"], r["value"]) for r in back.collect()) == [(0.0, 0.25), (0.2, 0.0015)]
    extra = written(tmp_path, "u.txt", "# head\nPGA        2.345678e-01\n\nSA(x) 1\nSA(10.0)  3e-1\n")
    assert sorted((r["period"], r["value"]) for r in records.read_spectrum(spark, extra).collect()) == [(0.0, 0.2345678), (10.0, 0.3)]
    node = lambda x, z: {"lon": x, "lat": -30.0, "depth_km": z}
    document = {"geometry_id": "g", "edges": [{"edge_index": 1, "edge_type": "bottom", "nodes": [node(-71.0, 40.0)]}, {"edge_index": 0, "edge_type": "top", "nodes": [node(-72.0, 10.0), node(-72.5, 10.0)]}]}
    edges = records.read_edges(spark, written(tmp_path, "g.json", json.dumps(document, indent=1))).orderBy("edge").collect()
    assert [(r["geometry"], r["edge"], r["type"], len(r["nodes"]), r["nodes"][0]["depth"]) for r in edges] == [("g", 0, "top", 2, 10.0), ("g", 1, "bottom", 1, 40.0)]


def test_forecasts_and_results(spark, tmp_path):
    cells = spark.createDataFrame([(-70.0, -69.9, -30.0, -29.9, 0.0, 30.0, 1.25e-3, 0.5)], "west double, east double, south double, north double, upper double, lower double, rate double, dispersion double")
    records.write_lines(records.forecast_lines(cells, 4.95).coalesce(1), str(tmp_path / "f"), records.FORECAST_HEAD)
    lines = next((tmp_path / "f").glob("part-*.csv")).read_text().splitlines()
    assert lines == [records.FORECAST_HEAD, "-70.0,-69.9,-30.0,-29.9,0.0,30.0,5.0,10.5,1.2500000000000000e-03,0.500000,1"]
    rates = cells.drop("rate").selectExpr("*", "explode(array(struct(0 as bin, 0.5 as rate), struct(2 as bin, 0.25 as rate))) as b").selectExpr("*", "b.bin", "cast(b.rate as double) as rate").drop("b")
    value = records.bin_lines(rates, [5.0, 5.1, 5.2]).first()["value"].split(",")
    assert [float(v) for v in value[6:]] == [0.5, 0.0, 0.25, 0.5]
    records.write_results(spark.createDataFrame([("n", 1.5, None)], "name string, a double, b double").coalesce(1), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("part-*.txt")).read_text()) == {"name": "n", "a": 1.5, "b": None}
