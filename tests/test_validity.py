"""Ring crossing and containment against a plain version that tests all pairs of edges."""

import itertools
import json
import math
import random

import pytest

from placegrid.operators import validity


def _sign(v):
    return (v > 0) - (v < 0)


def _side(p, q, r):
    return _sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))


def _on(p, q, r):
    return _side(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])


def _where(ring, r):
    """1 inside, 0 on, -1 outside."""
    edges = list(zip(ring, ring[1:]))
    if any(_on(p, q, r) for p, q in edges):
        return 0
    n = sum((p[1] > r[1]) != (q[1] > r[1]) and r[0] < (q[0] - p[0]) * (r[1] - p[1]) / (q[1] - p[1]) + p[0] for p, q in edges)
    return 1 if n % 2 else -1


def _plain_valid(polygons):
    rings = [(i, j, [p for p, before in zip(r, [None, *r]) if p != before]) for i, polygon in enumerate(polygons) for j, r in enumerate(polygon)]
    for _, _, r in rings:
        if len(r) < 4 or r[0] != r[-1] or sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:])) == 0:
            return False
    touches = {}
    for x, y in itertools.combinations_with_replacement(rings, 2):
        for k, (p, q) in enumerate(zip(x[2], x[2][1:])):
            for m, (s, t) in enumerate(zip(y[2], y[2][1:])):
                if x is y and k >= m:
                    continue
                a, b, c, d = _side(p, q, s), _side(p, q, t), _side(s, t, p), _side(s, t, q)
                points = [r for r, hit in ((s, _on(p, q, s)), (t, _on(p, q, t)), (p, _on(s, t, p)), (q, _on(s, t, q))) if hit]
                overlap = a == b == c == d == 0 and len(set(map(tuple, points))) > 1
                if a * b < 0 and c * d < 0 or overlap:
                    return False
                if points and x is y and m - k not in (1, len(x[2]) - 2):
                    return False
                if points and x is not y and x[0] == y[0]:
                    touches.setdefault((x[:2], y[:2]), set()).add(tuple(points[0]))
    if any(len(v) > 1 for v in touches.values()):
        return False
    for i, j, r in rings:
        for point in r:
            for k, polygon in enumerate(polygons):
                at = [_where(ring, point) for ring in polygon]
                if k != i and 0 not in at and sum(v > 0 for v in at) % 2:
                    return False
                if k == i and (j > 0 and at[0] < 0 or any(v > 0 for m, v in enumerate(at) if m not in (0, j))):
                    return False
    return True


def _square(x, y, size, back=False):
    ring = [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]
    return ring[::-1] if back else ring


def _star(rng, x, y, points, size):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(points))
    ring = [[round(x + size * rng.uniform(.4, 1) * math.cos(t), 3), round(y + size * rng.uniform(.4, 1) * math.sin(t), 3)] for t in turns]
    return ring + ring[:1]


NAMED = {
    "square": ([[_square(0, 0, 4)]], True),
    "bow tie": ([[[[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]]]], False),
    "lopsided bow tie": ([[[[0, 0], [4, 4], [4, 0], [0, 6], [0, 0]]]], False),
    "touches itself": ([[[[0, 0], [4, 0], [4, 4], [2, 0], [0, 4], [0, 0]]]], False),
    "spike": ([[[[0, 0], [4, 0], [4, 4], [4, 8], [4, 4], [0, 4], [0, 0]]]], False),
    "repeated point": ([[[[0, 0], [4, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]], True),
    "hole": ([[_square(0, 0, 4), _square(1, 1, 2, True)]], True),
    "hole outside": ([[_square(0, 0, 4), _square(5, 1, 2)]], False),
    "hole across": ([[_square(0, 0, 4), _square(3, 1, 2)]], False),
    "hole around": ([[_square(0, 0, 4), _square(-1, -1, 9)]], False),
    "hole touches at a point": ([[_square(0, 0, 4), [[0, 2], [2, 1], [2, 3], [0, 2]]]], True),
    "hole touches at two points": ([[_square(0, 0, 4), [[0, 2], [2, 1], [4, 2], [2, 3], [0, 2]]]], False),
    "hole shares an edge": ([[_square(0, 0, 4), _square(0, 1, 2)]], False),
    "hole in a hole": ([[_square(0, 0, 9), _square(1, 1, 6), _square(2, 2, 1)]], False),
    "two holes": ([[_square(0, 0, 9), _square(1, 1, 2), _square(5, 5, 2)]], True),
    "two polygons": ([[_square(0, 0, 1)], [_square(3, 0, 1)]], True),
    "two that touch at a point": ([[_square(0, 0, 1)], [_square(1, 1, 1)]], True),
    "two with a common edge": ([[_square(0, 0, 1)], [_square(1, 0, 1)]], False),
    "one in the other": ([[_square(0, 0, 9)], [_square(2, 2, 1)]], False),
    "island in a lake": ([[_square(0, 0, 9), _square(1, 1, 6)], [_square(2, 2, 1)]], True),
    "the same twice": ([[_square(0, 0, 3)], [_square(0, 0, 3)]], False),
    "not closed": ([[[[0, 0], [1, 0], [1, 1], [0, 1]]]], False),
    "flat": ([[[[0, 0], [1, 0], [2, 0], [0, 0]]]], False),
    "wide comb": ([[[[0, 0], *[[k, 1 + k % 2 * 5] for k in range(40)], [40, 0], [0, 0]]]], True),
}


@pytest.mark.parametrize("per_band", [4, 1000])
def test_validity_equals_the_plain_version(spark, monkeypatch, per_band):
    plain = validity.banded_edges
    monkeypatch.setattr(validity, "banded_edges", lambda *a: plain(*a, per_band=per_band))
    shapes = {name: polygons for name, (polygons, _) in NAMED.items()}
    rng = random.Random(8)
    for k in range(120):
        polygons = [[_star(rng, 0, 0, rng.randint(4, 30), 9)]]
        if k % 2:
            polygons[0].append(_star(rng, rng.uniform(-6, 6), 0, 5, 2))
        if k % 3 == 0:
            polygons.append([_star(rng, rng.uniform(-20, 20), 0, 6, 3)])
        if k % 5 == 0:
            rng.shuffle(polygons[0][0])
            polygons[0][0].append(polygons[0][0][0])
        shapes[f"star {k}"] = polygons
    want = {name: _plain_valid(polygons) for name, polygons in shapes.items()}
    assert {name: want[name] for name in NAMED} == {name: valid for name, (_, valid) in NAMED.items()}
    assert 20 < sum(want[f"star {k}"] for k in range(120)) < 100
    rows = [(name, json.dumps({"type": "MultiPolygon", "coordinates": p})) for name, p in shapes.items()]
    rows += [(f"{name} alone", json.dumps({"type": "Polygon", "coordinates": p[0]})) for name, p in shapes.items() if len(p) == 1]
    rows += [("point", '{"type":"Point","coordinates":[1,2]}'), ("none", None), ("text", "no geometry"), ("empty", '{"type":"Polygon","coordinates":[]}')]
    table = spark.createDataFrame(rows, "name string, geometry string")
    got = {r["name"]: r["valid"] for r in validity.with_validity(table, "geometry", "valid").collect()}
    assert len(got) == len(rows) and not any(got[n] for n in ("point", "none", "text", "empty"))
    assert {n: v for n, v in got.items() if v != want.get(n.removesuffix(" alone"), False)} == {}


def test_edges_meet_by_key_and_band(spark):
    table = spark.createDataFrame([(1, json.dumps({"type": "Polygon", "coordinates": [_square(0, 0, 4)]}))], "id long, geometry string")
    edges = validity.banded_edges(table, "id", "geometry")
    plan = validity.meeting_edges(edges, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, " in plan and "(band#" in plan and "Cartesian" not in plan
    tall = [[0, 0], *[[k, 1 + k % 2 * 5] for k in range(400)], [400, 0], [0, 0]]
    comb = spark.createDataFrame([(1, json.dumps({"type": "Polygon", "coordinates": [tall]}))], "id long, geometry string")
    assert validity.banded_edges(comb, "id", "geometry").count() <= 2.2 * 403
