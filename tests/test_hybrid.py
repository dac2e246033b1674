"""Weights of a seismic and a fault field against plain loops."""

import math

from quakespark.operators import hybrid as H


def test_likelihoods_and_fields(spark):
    cells = [(1, 4.0, 1.0, True), (2, 1.0, 3.0, True), (3, 0.0, 1.0, True), (4, 7.0, 9.0, False)]
    counts = [(1, 10, 3), (2, 10, 1), (3, 12, 2), (4, 12, 5), (1, 14, 0)]
    c = spark.createDataFrame(cells, "cell long, seismic double, fault double, masked boolean")
    n = spark.createDataFrame(counts, "cell long, bin long, n long")
    s, f = {1: 4.0, 2: 1.0, 3: 0.0}, {k: v * 5 / 5 for k, v in {1: 1.0, 2: 3.0, 3: 1.0}.items()}
    got = {(r["bin"], r["weight"]): r["likelihood"] for r in H.weight_likelihoods(c, n, [0.0, 0.5, 1.0]).collect()}
    assert set(got) == {(b, w) for b in (10, 12) for w in (0.0, 0.5, 1.0)}
    for (b, w), v in got.items():
        events = {cell: k for cell, bin_, k in counts if bin_ == b and cell in s and k}
        total = sum(events.values())
        mu = {cell: total * (w * s[cell] + (1 - w) * f[cell]) / 5 for cell in events}
        want = -math.inf if min(mu.values()) == 0 else sum(k * math.log10(mu[cell]) - math.log10(math.factorial(k)) for cell, k in events.items()) - total
        assert v == want or abs(v - want) < 1e-9
    assert {tuple(r) for r in H.best_weights(H.weight_likelihoods(c, n, [0.0, 0.5, 1.0])).collect()} == {(10, 1.0), (12, 0.0)}
    points = spark.createDataFrame([(4.0, 0.9), (5.0, 0.7), (6.0, 0.5), (7.0, 0.2), (8.0, 0.3)], "m double, weight double")
    low, high = H.fit_ramp(points, 5.0, 7.0)
    cost = lambda a, b: sum((w - a * (1 - t) - b * t) ** 2 for w, t in ((0.9, 0), (0.7, 0), (0.5, 0.5), (0.2, 1), (0.3, 1)))
    assert all(cost(low, high) < cost(low + da, high + db) for da, db in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))
    assert H.fit_ramp(points.limit(1), 5.0, 7.0) is None and H.fit_ramp(points.limit(0), 5.0, 7.0) is None
    rates = {(r["cell"], r["m"]): (r["rate"], r["at_or_above"]) for r in H.weighted_fields(c, (0.8, 0.2), 5.0, 7.0, [5.0, 6.0, 8.0]).collect()}
    assert abs(rates[1, 6.0][0] - (0.5 * 4 + 0.5 * 1)) < 1e-9 and rates[4, 6.0][0] == 7.0
    assert abs(rates[1, 5.0][1] - sum(rates[1, m][0] for m in (5.0, 6.0, 8.0))) < 1e-9 and rates[1, 8.0][0] == rates[1, 8.0][1]
