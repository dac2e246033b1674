"""Source models written as XML and read back, by this library and by a plain XML parser."""

import xml.etree.ElementTree as ET
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from quakespark.sources import files, models

PLANES = "array<struct<probability: double, strike: double, dip: double, rake: double>>"
COMMON = "id string, name string, region string, scaling string, aspect double, rates array<double>, width double, a double, b double, m_min double, m_max double"


def law(i):
    return ([0.5, 0.25 / i, 0.0, 1e-7, 0.0, 0.0], 0.1, None, None, 5.05, None) if i % 2 else (None, None, 4.0 + i, 0.9, 5.0, 7.5)


def points(spark):
    rows = [(f"p{i:03d}", f'Arc & <slab> "{i}"', "Subduction", "WC1994", 1.5, *law(i), -70.0 - i / 8, -30.0, 0.0, 30.0, [(0.75, 10.0, 20.0, 90.0), (0.25, 190.0, 70.0, 90.0)], [(1.0, 12.5)]) for i in range(1, 8)]
    rows += [("zero", "n", "r", "WC1994", 1.5, [0.0, 0.0], 0.1, None, None, 5.0, None, -70.0, -30.0, 0.0, 30.0, [], []), ("upside", "n", "r", "WC1994", 1.5, *law(1), -70.0, -30.0, 30.0, 10.0, [], [])]
    return spark.createDataFrame(rows, f"{COMMON}, lon double, lat double, upper double, lower double, planes {PLANES}, depths array<struct<probability: double, depth: double>>")


def test_points_and_tree(spark, tmp_path):
    held = models.usable(points(spark))
    paths = models.write_source_model(held, models.point_xml(), str(tmp_path / "ssm"), "A & B", per_file=3)
    assert len(paths) == 3
    sizes = []
    for p in paths:
        root = ET.parse(unquote(urlparse(p).path)).getroot()
        assert root.tag == f"{{{models.NRML}}}nrml" and root[0].get("name") == "A & B"
        sizes.append(len(root[0]))
        assert root.find(f".//{{{models.GML}}}pos") is not None
    assert sizes == [3, 3, 1]
    back = models.read_sources(spark, str(tmp_path / "ssm" / "*"))
    want = {r["id"]: r for r in held.collect()}
    got = {r["id"]: r for r in back.collect()}
    assert set(got) == set(want) == {f"p{i:03d}" for i in range(1, 8)}
    for i, r in got.items():
        w = want[i]
        assert all(r[c] == w[c] for c in ("name", "region", "scaling", "aspect", "lon", "lat", "upper", "lower", "planes", "depths", "width", "a", "b", "m_min", "m_max"))
        assert r["rates"] == (w["rates"] and w["rates"][:4])
    grid = held.select(F.posexplode("rates").alias("bin", "rate"))
    assert all(abs(r["difference"]) < 1e-15 for r in models.rate_differences(grid, back).collect())
    old = files.read_point_sources(spark, str(tmp_path / "ssm" / "*")).where("a is not null")
    assert {r["id"] for r in old.collect()} == {"p002", "p004", "p006"}
    branch = lambda *rows: spark.createDataFrame(list(rows), "branch_id string, files array<string>, weight double")
    product = models.branch_product([branch(("", ["base.xml"], 1.0)), branch(("f1", ["f&1.xml"], 0.4), ("none", [], 0.6)), branch(("a", ["a.xml"], 0.5), ("b", ["b.xml"], 0.5))])
    assert sorted((r["branch_id"], len(r["files"]), round(r["weight"], 9)) for r in product.collect()) == [("f1_a", 3, 0.2), ("f1_b", 3, 0.2), ("none_a", 2, 0.3), ("none_b", 2, 0.3)]
    tree = models.write_logic_tree(product, str(tmp_path / "tree"))
    read = {r["branch_id"]: r for r in files.read_logic_tree(spark, str(tmp_path / "tree")).collect()}
    assert read["f1_a"]["model"] == "base.xml f&1.xml a.xml" and abs(read["none_b"]["weight"] - 0.3) < 1e-12
    assert ET.parse(unquote(urlparse(tree).path)).getroot().tag == f"{{{models.TREE_NRML}}}nrml"
    with pytest.raises(ValueError):
        models.write_logic_tree(branch(("x", ["x.xml"], 0.5)), str(tmp_path / "bad"))
    assert [r["branch_id"] for r in models.branch_product([branch(("", [], 1.0)), branch(("", [], 1.0))]).collect()] == ["b1"]


def test_faults(spark, tmp_path):
    node = "struct<lon: double, lat: double, depth: double>"
    simple = spark.createDataFrame([("s1", "Falla Ñ", "Crustal", "WC1994", 1.0, *law(1), [(-70.0, -30.0), (-70.25, -30.5)], 60.0, 90.0, 0.0, 15.0)], f"{COMMON}, trace {models.CORNER}, dip double, rake double, upper double, lower double")
    models.write_source_model(simple, models.simple_fault_xml(), str(tmp_path / "simple"), "faults")
    r, w = models.read_sources(spark, str(tmp_path / "simple" / "*"), "simpleFaultSource").first(), simple.first()
    assert all(r[c] == w[c] for c in ("id", "name", "trace", "dip", "rake", "upper", "lower", "m_min"))
    edges = [[(-72.0, -30.0, 10.0), (-72.0, -31.0, 10.0)], [(-71.5, -30.0, 25.0), (-71.5, -31.0, 25.0)], [(-71.0, -30.0, 40.0), (-71.0, -31.0, 40.0)]]
    for n, some in (("three", edges), ("two", edges[::2])):
        held = spark.createDataFrame([("c1", "Interface", "Subduction", "Strasser", 1.0, *law(2), some, 90.0)], f"{COMMON}, edges array<array<{node}>>, rake double")
        models.write_source_model(held, models.complex_fault_xml(), str(tmp_path / n), "interface")
        r = models.read_sources(spark, str(tmp_path / n / "*"), "complexFaultSource").first()
        assert r["edges"] == held.first()["edges"] and (r["a"], r["b"], r["m_max"], r["rates"]) == (6.0, 0.9, 7.5, None)
