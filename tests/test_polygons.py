"""Polygon regions, offsets, spans and chains against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pipeloom.operators.chains import directed_rings, merged_lines, ranked_chains
from pipeloom.operators.polygons import areas, backwards, inside_spans, offset_curves, points_in, region, ring_edges, zone_spans

RINGS = "key long, d double, rings array<array<struct<x:double,y:double>>>"
CURVES = "key long, x1 double, y1 double, x2 double, y2 double"


def star(draw, x, y, size, n=None):
    n = n or draw.randint(3, 12)
    angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * draw.uniform(0.3, 1) * math.cos(a), y + size * draw.uniform(0.3, 1) * math.sin(a)) for a in angles]


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def apart(edges):
    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    return all(not (cross(*e, f[0]) * cross(*e, f[1]) < 0 and cross(*f, e[0]) * cross(*f, e[1]) < 0) for i, e in enumerate(edges) for f in edges[:i])


def polygons(draw, many):
    out = []
    while len(out) < many:
        ring = star(draw, draw.uniform(0, 200), draw.uniform(0, 200), draw.uniform(2, 30))
        if apart(edges_of([ring])) and shoelace(ring) > 0:
            x, y = sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
            hole = [(x + (p[0] - x) * 0.3, y + (p[1] - y) * 0.3) for p in reversed(ring)]
            inside = apart(edges_of([ring, hole])) and all(winding(edges_of([ring]), *p) == 1 for p in hole)
            out.append((len(out), draw.uniform(0.1, 6), [ring, hole] if inside and len(out) % 3 == 0 else [ring]))
    return out


def edges_of(rings):
    return [e for r in rings for e in zip(r, r[1:] + r[:1])]


def winding(edges, x, y):
    w = 0
    for (x1, y1), (x2, y2) in edges:
        if (x1 > x) != (x2 > x) and y1 + (y2 - y1) * (x - x1) / (x2 - x1) > y:
            w += 1 if x1 > x2 else -1
    return w


def slab_area(edges, inside):
    """The area where the winding number counts as inside, slab by slab between the x of all ends and crossings."""
    xs = {p[0] for e in edges for p in e}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
            if det := rx * sy - ry * sx:
                t, u = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / det, ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / det
                if 0 <= t <= 1 and 0 <= u <= 1:
                    xs.add(a[0] + t * rx)
    xs, total = sorted(xs), 0.0
    for lo, hi in zip(xs, xs[1:]):
        m, cut = (lo + hi) / 2, []
        for (x1, y1), (x2, y2) in edges:
            if min(x1, x2) <= lo and max(x1, x2) >= hi and x1 != x2:
                cut.append((y1 + (y2 - y1) * (m - x1) / (x2 - x1), 1 if x2 > x1 else -1))
        cut.sort()
        w = 0
        for (y, s), (y2, _) in zip(cut, cut[1:]):
            w += s
            total += (hi - lo) * (y2 - y) * inside(w)
    return total


def frame(spark, rows):
    return spark.createDataFrame([(k, float(d), [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, d, rings in rows], RINGS)


def grown(rings, d):
    """The offset curve, vertex by vertex."""
    out = []
    for r in rings:
        walk = []
        for i, q in enumerate(r):
            p, s = r[i - 1], r[(i + 1) % len(r)]
            e, g = [((b[0] - a[0]) / math.dist(a, b), (b[1] - a[1]) / math.dist(a, b)) for a, b in ((p, q), (q, s))]
            a, b = (q[0] + d * e[1], q[1] - d * e[0]), (q[0] + d * g[1], q[1] - d * g[0])
            bend = math.atan2(e[0] * g[1] - e[1] * g[0], e[0] * g[0] + e[1] * g[1])
            if bend > 0:
                t = d * math.tan(bend / 4)
                walk += [a, (a[0] + t * e[0], a[1] + t * e[1]), (b[0] - t * g[0], b[1] - t * g[1]), b]
            else:
                walk += [a, q, b]
        out.append(walk)
    return out


def test_offsets_and_rings_of_a_thousand_polygons(spark):
    draw = random.Random(11)
    rows = polygons(draw, 1000)
    table = frame(spark, rows)
    zone = region(offset_curves(table, "d"))
    got = {r.key: r.area for r in areas(zone).collect()}
    ring = {r.key: r.area for r in areas(region(zone.unionByName(backwards(ring_edges(table).drop("ring", "i"))))).collect()}
    for key, d, rings in rows:
        want = slab_area(edges_of(grown(rings, d)), lambda w: w >= 1)
        own = sum(map(shoelace, rings))
        assert abs(got[key] - want) < 1e-5 and abs(ring[key] - (want - own)) < 1e-5, key
        if len(rings) == 1 and all((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) > 0 for a, b, c in zip(rings[0], rings[0][1:] + rings[0][:1], rings[0][2:] + rings[0][:2])):
            r = rings[0]
            bends = [math.acos(max(-1, min(1, ((b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1])) / math.dist(a, b) / math.dist(b, c)))) for a, b, c in zip(r, r[1:] + r[:1], r[2:] + r[:2])]
            closed = own + d * sum(math.dist(a, b) for a, b in zip(r, r[1:] + r[:1])) + sum(2 * d * d * math.tan(b / 4) for b in bends)
            assert abs(closed - got[key]) < 1e-5
    closed = directed_rings(zone, "key").groupBy("key").agg(F.count("*").alias("n")).collect()
    assert {r.key for r in closed} == set(got)
    made = directed_rings(zone, "key").collect()
    total = {}
    for r in made:
        total[r.key] = total.get(r.key, 0) + shoelace([(p.x, p.y) for p in r.points])
    assert all(abs(total[k] - got[k]) < 1e-5 for k in got)


@pytest.mark.parametrize("how", ["union", "intersection", "difference"])
def test_overlays_cover_the_right_points(spark, how):
    draw = random.Random(5)
    left, right = polygons(draw, 150), polygons(draw, 150)
    shift = {k: (l[2][0][0][0] - r[2][0][0][0], l[2][0][0][1] - r[2][0][0][1]) for k, (l, r) in enumerate(zip(left, right))}
    right = [(k, d, [[(x + shift[k][0], y + shift[k][1]) for x, y in r] for r in rings]) for k, d, rings in right]
    a, b = (ring_edges(frame(spark, rows)).drop("ring", "i") for rows in (left, right))
    both = a.unionByName(backwards(b) if how == "difference" else b)
    out = region(both, {"union": lambda w: w >= 1, "intersection": lambda w: w >= 2, "difference": lambda w: w >= 1}[how])
    got = {r.key: r.area for r in areas(out).collect()}
    for (k, _, p), (_, _, q) in zip(left, right):
        e, f = edges_of(p), edges_of(q)
        want = slab_area(e + ([(y, x) for x, y in f] if how == "difference" else f), lambda w: w >= (2 if how == "intersection" else 1))
        assert abs(got.get(k, 0.0) - want) < 1e-5, k
    points = [(1000 * k + i, draw.uniform(-5, 230), draw.uniform(-5, 230)) for k in range(10) for i in range(100)]
    held = {(r.p, r.key) for r in points_in(spark.createDataFrame(points, "p long, x double, y double"), out, "p").collect()}
    for i, x, y in points:
        for (k, _, p), (_, _, q) in zip(left, right):
            m, n = winding(edges_of(p), x, y), winding(edges_of(q), x, y)
            assert ((i, k) in held) == {"union": m + n >= 1, "intersection": m + n >= 2, "difference": m - n >= 1}[how]


SHAPES = {
    "bow-tie": ([(0, 0), (4, 4), (4, 0), (0, 4)], 8.0), "spike": ([(0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 4)], 16.0), "clockwise": ([(0, 0), (0, 3), (3, 3), (3, 0)], 9.0),
    "open": ([(0, 0), (5, 0), (5, 2)], 5.0), "twice": ([(0, 0), (2, 0), (2, 2), (0, 2)] * 2, 4.0), "flat": ([(0, 0), (3, 0), (1, 0)], None), "repeated point": ([(0, 0), (0, 0), (2, 0), (2, 2), (2, 2), (0, 2), (0, 0)], 4.0), "line": ([(0, 0), (1, 1)], None),
}


def test_repair(spark):
    names = list(SHAPES)
    table = frame(spark, [(k, 0, [SHAPES[n][0]]) for k, n in enumerate(names)] + [(100, 0, [])])
    fixed = region(ring_edges(table), lambda w: w != 0)
    got = {r.key: r.area for r in areas(fixed).collect()}
    for k, n in enumerate(names):
        assert got.get(k) == (None if SHAPES[n][1] is None else pytest.approx(SHAPES[n][1])), n
    rings = {}
    for r in directed_rings(fixed, "key").collect():
        rings.setdefault(names[r.key], []).append(len(r.points))
    assert sorted(rings["bow-tie"]) == [3, 3] and rings["spike"] == [4] and region(ring_edges(table.limit(0))).count() == 0


def test_shared_borders_go_in_unions(spark):
    square = lambda x, y: [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    parts = [(7, 0, [square(x, y)]) for x in range(4) for y in range(3)] + [(8, 0, [square(0, 0)]), (8, 0, [square(1, 1)]), (8, 0, [[(0.5, 1.0), (1.0, 1.0), (1.0, 2.0), (0.5, 2.0)]])]
    out = region(ring_edges(frame(spark, parts)).drop("ring", "i"))
    assert {r.key: round(r.area, 9) for r in areas(out).collect()} == {7: 12.0, 8: 2.5}
    assert {(r.key, len(r.points)) for r in directed_rings(out, "key").filter("key = 7").collect()} == {(7, 14)}  # ends of the parts stay as points


def test_spans(spark):
    draw = random.Random(2)
    rows = polygons(draw, 120)
    table, edges = frame(spark, rows), ring_edges(frame(spark, rows))
    ways = [(i, draw.uniform(-10, 210), draw.uniform(-10, 210), draw.uniform(-10, 210), draw.uniform(-10, 210)) for i in range(150)] + [(500, 50.0, 50.0, 50.0, 50.0), (501, 10.0, 90.0, 190.0, 90.0), (502, 100.0, 0.0, 100.0, 200.0)]
    frame_ways = spark.createDataFrame(ways, "route_id long, ax double, ay double, bx double, by double")
    at = {w[0]: (lambda t, w=w: (w[1] + t * (w[3] - w[1]), w[2] + t * (w[4] - w[2]))) for w in ways}
    spans = {}
    for r in inside_spans(frame_ways, edges).collect():
        spans.setdefault((r.route_id, r.key), []).append((r.lo, r.hi))
    zones = {}
    for r in zone_spans(frame_ways, table, "d").collect():
        zones.setdefault((r.route_id, r.key), []).append((r.lo, r.hi))
    for key, d, rings in rows:
        own, zone = edges_of(rings), edges_of(grown(rings, d))
        for w in ways:
            for s in (0.003 + k / 25 for k in range(25)):
                x, y = at[w[0]](s)
                assert any(lo <= s <= hi for lo, hi in spans.get((w[0], key), [])) == (winding(own, x, y) == 1) or w[0] == 500
                assert any(lo <= s <= hi for lo, hi in zones.get((w[0], key), [])) == (winding(zone, x, y) >= 1)


def test_chains(spark):
    draw = random.Random(9)
    names, links, want = list(range(1000)), {}, {}
    draw.shuffle(names)
    at = 0
    for size, closed in ((1, False), (1, True), (2, True), (7, False), (300, True), (400, False), (3, True)):
        own = names[at : at + size]
        at += size
        for a, b in zip(own, own[1:]):
            links[a] = b
        links[own[-1]] = own[0] if closed else None
        if closed:
            k = own.index(min(own))
            own = own[k:] + own[:k]
        want |= {s: (own[0] if closed else own[-1], p, closed) for p, s in enumerate(own)}
    got = ranked_chains(spark.createDataFrame(list(links.items()), "s long, next long")).collect()
    assert {r.s: (r.chain, r.place, r.closed) for r in got} == want


def test_lines_merge_back(spark):
    draw = random.Random(4)
    parts, want = [], []
    for line in range(60):
        points = [(line * 100 + draw.randint(0, 90), draw.randint(0, 9000)) for _ in range(draw.randint(2, 30))]
        points = [p for p, q in zip(points, [None, *points]) if p != q]
        if len(set(points)) < len(points) or len(points) < 2:
            continue
        if line % 5 == 0:
            points.append(points[0])
        want.append({frozenset(e) for e in zip(points, points[1:])})
        parts += [(a, b) if draw.random() < 0.5 else (b, a) for a, b in zip(points, points[1:])]
    star_parts = [((9000, 9000), (9100 + k, 9100)) for k in range(3)]  # three that meet stay apart
    draw.shuffle(parts)
    parts += [*star_parts, ((1, 1), (1, 1))]
    rows = [(i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for i, (a, b) in enumerate(parts)]
    got = {}
    for r in merged_lines(spark.createDataFrame(rows, "part long, x1 double, y1 double, x2 double, y2 double")).collect():
        got.setdefault(r.line, []).append((r.place, r.part, r.forward))
    sets = []
    for line, steps in got.items():
        steps.sort()
        assert [s[0] for s in steps] == list(range(len(steps))) and line == min(s[1] for s in steps)
        ways = [parts[p] if forward else parts[p][::-1] for _, p, forward in steps]
        assert all(a[1] == b[0] for a, b in zip(ways, ways[1:]))
        sets.append({frozenset(w) for w in ways})
    key = lambda s: sorted(map(sorted, s))
    assert sorted(sets, key=key) == sorted([*want, *({frozenset(p)} for p in star_parts)], key=key)
