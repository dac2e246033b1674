"""Readers on small files of each format."""

import pytest

from quakespark.sources import files


def written(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_catalog(spark, tmp_path):
    path = written(tmp_path, "c.csv", "id,time_iso,longitude,latitude,depth,mag,lon_error,source,extra\nA1,2001-07-02T12:00:00,-70,-30,x,5.5,relocated,isc,1\nA2,,-71,-31,10,,0.5,anss,2\n")
    first, second = files.read_catalog(spark, path).orderBy("id").collect()
    assert (first["depth"], first["lon_error"], first["lon_error_flag"], first["mag"]) == (None, None, "relocated", 5.5)
    assert abs(first["yr"] - (2001 + 182.5 / 365)) < 1e-9
    assert (second["time"], second["yr"], second["lon_error"], second["lon_error_flag"], second["Mrr"]) == (None, None, 0.5, None, None)


def test_completeness_and_grid(spark, tmp_path):
    path = written(tmp_path, "m.tsv", "start_iso\tend_iso\tN\tMc\tb\tYears\n1900-01-01\t1930-01-01\t12\t7.5\t0.9\t30\n")
    assert tuple(files.read_completeness(spark, path).first()) == ("1900-01-01", "1930-01-01", 12, 7.5, 0.9, 30.0)
    assert tuple(files.read_grid(spark, written(tmp_path, "g.csv", "lon,lat\n-70.5,-33\n")).first()) == (-70.5, -33.0, None)


def ndk(name):
    first = "PDE  2005/01/01 01:20:05.4  13.78  -88.78 193.1 5.0 0.0 EL SALVADOR"
    values = [(0.838, 0.201), (-0.005, 0.231), (-0.833, 0.270), (1.050, 0.121), (-0.369, 0.161), (0.044, 0.240)]
    tensor = "23" + "".join(f"{v:7.3f}{e:6.3f}" for v, e in values)
    last = f"{'V10   1.581 56  12  -0.537 23 140  -1.044 24 241 ':<49}{1.312:7.3f} {9:3d}{29:3d}{142:5d} {133:3d}{72:3d}{66:5d}"
    return "\n".join([first, f"{name:<16} B:  4    4  40", "CENTROID:     -0.3 0.9  13.76 0.06  -89.08 0.09 162.8 12.5 FREE", tensor, last])


def test_moment_tensors(spark, tmp_path):
    path = written(tmp_path, "a.ndk", ndk("C200501010120A") + "\n" + ndk("SECOND") + "\nleft over\n")
    rows = {r["id"]: r for r in files.read_moment_tensors(spark, path).collect()}
    r = rows["C200501010120A"]
    assert set(rows) == {"C200501010120A", "SECOND"} and (r["lat"], r["lon"], r["depth"]) == (13.76, -89.08, 162.8)
    assert abs(r["moment"] / 1.312e16 - 1) < 1e-9 and abs(r["Mrr"] / 0.838e16 - 1) < 1e-9 and abs(r["Mtp"] / 0.044e16 - 1) < 1e-9
    assert [r[c] for c in ("strike1", "dip1", "rake1", "strike2", "dip2", "rake2")] == [9, 29, 142, 133, 72, 66]
    assert r["time"].isoformat() == "2005-01-01T01:20:05.100000" and (r["lat_error"], r["lon_error"], r["depth_error"], r["mw"]) == (0.06, 0.09, 12.5, 4.7)


BRANCH = '<logicTreeBranch branchID="{}"><uncertaintyModel>m{}.xml</uncertaintyModel><uncertaintyWeight>{}</uncertaintyWeight></logicTreeBranch>'


def test_logic_tree(spark, tmp_path):
    tree = "<nrml><logicTree><logicTreeBranchSet>{}</logicTreeBranchSet></logicTree></nrml>"
    good = written(tmp_path, "good.xml", tree.format(BRANCH.format("b1", 1, 0.25) + BRANCH.format("b2", 2, 0.75)))
    assert {tuple(r) for r in files.read_logic_tree(spark, good).collect()} == {("b1", "m1.xml", 0.25), ("b2", "m2.xml", 0.75)}
    with pytest.raises(ValueError):
        files.read_logic_tree(spark, written(tmp_path, "bad.xml", tree.format(BRANCH.format("b1", 1, 0.25))))


def test_point_sources(spark, tmp_path):
    path = written(tmp_path, "p.xml", '<nrml><sourceModel><pointSource id="1" name="p"><pointGeometry><gml:Point xmlns:gml="g"><gml:pos>-70.5 -33</gml:pos></gml:Point></pointGeometry><truncGutenbergRichterMFD aValue="3.5" bValue="0.9" minMag="5" maxMag="7.5"/></pointSource></sourceModel></nrml>')
    assert tuple(files.read_point_sources(spark, path).first()) == ("1", "p", -70.5, -33.0, 3.5, 0.9, 5.0, 7.5)
