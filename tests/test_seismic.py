"""Catalog queries against their SQL, and the iterative ones against plain loops on small fixtures."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quakespark.functions import columns as K
from quakespark.jobs import seismic
from quakespark.operators import catalog as C
from quakespark.operators.graph import connected_components

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(seismic.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{FOLDER}/events.parquet'")
    assert rows(seismic.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.sql(seismic.ORACLES[name]).df())


def km(a, b):
    x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(max(x, 0), 1)))


def test_decluster_equals_greedy(spark):
    rng = random.Random(5)
    events = [(i, round(rng.uniform(0, 800), 2), round(rng.uniform(4, 7.5), 1), rng.uniform(-72, -70), rng.uniform(-34, -32)) for i in range(150)]
    order = sorted(events, key=lambda e: (-e[2], e[1], e[0]))
    parent = {}
    for e in order:
        if e[0] in parent:
            continue
        parent[e[0]] = e[0]
        days = 10 ** (0.032 * e[2] + 2.7389) if e[2] >= 6.5 else 10 ** (0.5409 * e[2] - 0.547)
        for o in order:
            if o[0] not in parent and -days <= o[1] - e[1] <= days and km(e[3:], o[3:]) <= 10 ** (0.1238 * e[2] + 0.983):
                parent[o[0]] = e[0]
    got = C.decluster(spark.createDataFrame(events, "id long, t double, mag double, lon double, lat double")).collect()
    assert {r["id"]: r["mainshock"] for r in got} == parent
    mains = [e[0] for e in order if parent[e[0]] == e[0]]
    assert {r["id"]: r["cluster_id"] for r in got} == {k: mains.index(v) + 1 for k, v in parent.items()}
    assert {r["id"] for r in got if r["is_mainshock"]} == {k for k, v in parent.items() if k == v}


def test_decluster_keeps_all_rows(spark):
    rows = [(1, 0.0, 7.0, -70.0, -33.0), (2, 1.0, 5.0, -70.1, -33.0), (3, None, 5.0, -70.0, -33.0), (4, 2.0, None, -70.0, -33.0), (5, -900.0, 6.0, -70.0, -33.0), (6, 5000.0, 6.0, 10.0, 10.0)]
    got = {r["id"]: tuple(r)[1:] for r in C.decluster(spark.createDataFrame(rows, "id long, t double, mag double, lon double, lat double"), since=-500.0).collect()}
    assert got == {1: (True, 1, 1), 2: (False, 1, 1), 3: (True, 3, 0), 4: (True, 4, 0), 5: (True, 5, 0), 6: (True, 6, 2)}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == label


def test_scalars(spark):
    r = spark.range(1).select(
        K.wrap_longitude(F.lit(359.5)).alias("lon"), K.magnitude(K.moment(F.lit(6.0))).alias("m"), K.canonical_id(F.lit(" A123<x>")).alias("id"),
        K.safe_log10(F.lit(0.0)).alias("log"), C.step_value(F.lit(4.5), [(4.0, 1.0), (4.5, 2.0)]).alias("step"), C.step_value(F.lit(3.0), [(4.0, 1.0)]).alias("below"),
    ).first()
    assert (r["lon"], round(r["m"], 9), r["id"], r["log"], r["step"], r["below"]) == (-0.5, 6.0, "123", None, 2.0, None)


def test_dense_clusters_make_few_pairs(spark, monkeypatch):
    """Bands that widen give the components of all pairs, and make a part of these."""
    from quakespark.operators.graph import linked_in_time

    rng = random.Random(4)
    rows = [(i, rng.uniform(0, 2000), rng.uniform(4, 6), rng.uniform(-72, -70), rng.uniform(-31, -29)) for i in range(600)]
    df = spark.createDataFrame([*rows, (900, None, 5.0, -70.0, -30.0)], "id long, t double, mag double, lon double, lat double")
    made = []

    def pairs(a, b, s):
        out = C.band_pairs(a, s, 300.0, 1.0, b)
        made.append(out.count())
        return out

    got = {tuple(r) for r in linked_in_time(df, pairs, 200.0, neighbours=20.0).collect()}
    full = C.band_pairs(df, 200.0, 300.0, 1.0)
    want = {r["node"]: r["component"] for r in connected_components(full, "a_id", "b_id").collect()}
    assert got == {(i, want.get(i, i)) for i in [*range(600), 900]} and len(made) > 1 and sum(made) < full.count() / 2


def test_nearest_match_by_widening_bands(spark):
    """Few neighbours at first give the same matches as the whole band at once."""
    rng = random.Random(5)
    row = lambda i: (i, float(rng.randrange(0, 3000)), rng.choice([None, rng.uniform(4, 8)]), rng.uniform(-72, -70), rng.uniform(-31, -29))
    make = lambda n, k: spark.createDataFrame([row(i + k) for i in range(n)], "id long, t double, mag double, lon double, lat double")
    left, right = make(80, 0), make(60, 1000)
    whole, steps = ({tuple(r) for r in C.nearest_match(left, right, 60.0, 0.3, n).collect()} for n in (1e9, 1.0))
    assert whole == steps and len(whole) == 80 and any(r[1] is None for r in whole) and any(r[1] for r in whole)


def test_ordered_pairs_come_in_runs(spark):
    """Ordered pairs are the same pairs; each a comes in one run, with its b in order of time and id, whatever the order of the rows."""
    rng = random.Random(12)
    places = [(rng.uniform(-75, -66), rng.uniform(-56, -18)) for _ in range(20)]
    rows = [(i, None if i % 97 == 0 else float(i % 50 * 13), None if i % 89 == 0 else 5.0 + i % 7 / 5, *places[i % 20]) for i in range(600)] + [(700, 10.0, 5.0, None, -20.0), (701, 10.0, 5.0, -70.0, float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, t double, mag double, lon double, lat double").repartition(7)
    plain = sorted(tuple(r) for r in C.band_pairs(df, 120.0, 600.0, 0.801).select("a_id", "b_id", "km").collect())
    got = [tuple(r) for r in C.band_pairs(df, 120.0, 600.0, 0.801, ordered=True).select("a_id", "b_id", "km", "a_t", "b_t", "bucket").collect()]
    assert sorted(r[:3] for r in got) == plain and len(plain) > 1000
    by_hand = sorted(
        (a[0], b[0]) for a in rows for b in rows
        if None not in (*a, *b) and 0 <= b[1] - a[1] <= 120 and (b[1] > a[1] or b[0] > a[0]) and abs(a[2] - b[2]) <= 0.801 and km(a[3:], b[3:]) <= 600
    )
    assert [r[:2] for r in plain] == by_hand
    runs = [k for i, k in enumerate(got) if not i or k[0] != got[i - 1][0] or k[5] != got[i - 1][5]]
    assert len(runs) == len({(r[0], r[5]) for r in got})
    assert all(y[:1] != x[:1] or y[5] != x[5] or (x[4], x[1]) < (y[4], y[1]) for x, y in zip(got, got[1:]))
