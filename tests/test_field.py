"""The kernel field without a cut-off against all pairs, within its stated error."""

import math
import random

import pytest

from quakespark.operators import smoothing as S


def km(a, b):
    (x1, y1), (x2, y2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1)))


@pytest.mark.parametrize("power", [1.0, 1.5])
def test_whole_field_within_its_error(spark, power):
    rng = random.Random(4)
    events = [(rng.uniform(-76, -66), rng.uniform(-56, -18), rng.uniform(0.5, 2), rng.choice([5.0, 17.3, 60.0])) for _ in range(80)] + [(179.9, -30.0, 1.0, 10.0), (-70.0, -30.0, 0.0, 5.0)]
    cells = [(i * 100 + j, -76 + i / 2, -56 + j / 2, 1.0 + i) for i in range(0, 20, 2) for j in range(0, 76, 3)] + [(9999, -179.9, -30.0, 2.0)]
    e = spark.createDataFrame(events, "lon double, lat double, weight double, d double")
    g = spark.createDataFrame(cells, "cell long, lon double, lat double, area double")
    want = dict.fromkeys((c[0] for c in cells), 0.0)
    for x, y, w, d in events:
        if w > 0:
            k = {c[0]: (km((x, y), c[1:3]) ** 2 + d * d) ** -power for c in cells}
            for cell, v in k.items():
                want[cell] += w * v / sum(k.values())
    got = {r["cell"]: r["rate"] for r in S.whole_field(e, g, power).collect()}
    bound = S.field_error(0.1, power, 0.02)
    errors = [abs(got[c] / want[c] - 1) for c in want]
    assert max(errors) <= bound and sum(errors) / len(errors) < bound / 10
    if power == 1.5:
        area = {c[0]: c[3] for c in cells}
        whole = sum(want[c] / area[c] for c in want)
        one = {r["cell"]: r["rate"] for r in S.whole_field(e, g, power, by_area=True, to_one=True).collect()}
        assert abs(sum(one.values()) - 1) < 1e-9 and max(abs(one[c] * area[c] * whole / want[c] - 1) for c in want) <= bound
        exact = {r["cell"]: r["rate"] for r in S.whole_field(e, g, power, theta=0.0, step=1e-6).collect()}
        assert max(abs(exact[c] / want[c] - 1) for c in want) < 1e-6
