"""Queries without oracle SQL against plain Python over the smallest tables."""

import math
from collections import defaultdict

from pipeloom.plans import assembly, geometry
from pipeloom.sources.views import view


def test_varied_attempts(spark, sf_dir):
    place = {r.chamber_id: (r.x, r.y, r.used_ports < 2) for r in view(spark, sf_dir, "chamber").collect()}
    cost = defaultdict(dict)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as l_orderkey", "o_custkey"), "l_orderkey")
    for r in lines.select("o_custkey", "l_suppkey", "l_quantity").collect():
        known = cost[r.o_custkey]
        known[r.l_suppkey] = min(known.get(r.l_suppkey, math.inf), float(r.l_quantity))
    want = set()
    for customer, known in cost.items():
        tried = [s for _, s in sorted((c, s) for s, c in known.items() if s in place)]
        far = lambda s, kept: all(math.dist(place[s][:2], place[k][:2]) >= 15 for k in kept)
        kept = tried[:1]
        kept += [s for s in tried if place[s][2] and far(s, kept)][:1]
        for s in tried:
            if len(kept) < 3 and far(s, kept):
                kept.append(s)
        want |= {(customer, i, s) for i, s in enumerate(kept)}
    assert {(r.o_custkey, r.place, r.chamber_id) for r in assembly.varied_attempts(spark, sf_dir).collect()} == want


def test_free_points(spark, sf_dir):
    lines = defaultdict(list)
    for r in geometry.vertices(spark, sf_dir).orderBy("line_id", "seq").collect():
        lines[r.line_id].append((r.x, r.y))

    def at(line, m):
        for a, b in zip(line, line[1:]):
            d = math.dist(a, b)
            if m < d:
                return a[0] + (b[0] - a[0]) * m / d, a[1] + (b[1] - a[1]) * m / d
            m -= d
        return None

    def nearest(line, p):
        best, done = (math.inf, 0.0), 0.0
        for a, b in zip(line, line[1:]):
            d = math.dist(a, b)
            t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d**2))
            best = min(best, (round(math.dist(p, (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)), 9), done + t * d))
            done += d
        return best

    want = set()
    for o in view(spark, sf_dir, "oks").collect():
        p = (o.x, o.y)
        near = sorted((round(d, 6), i, m) for i, line in lines.items() if i != o.oks_id for d, m in [nearest(line, p)] if d <= 10)[:2]
        kept = []
        for pipe, (_, i, m0) in enumerate(near, 1):
            size = sum(math.dist(a, b) for a, b in zip(lines[i], lines[i][1:]))
            for off in geometry.OFFSETS:
                m = m0 + off
                if 2 <= m <= size - 2 and all(math.dist(at(lines[i], m), k[4]) >= 10 for k in kept):
                    kept.append((pipe, round(math.dist(at(lines[i], m), p), 6), i, round(m, 4), at(lines[i], m)))
        want |= {(o.oks_id, n, k[2], k[3]) for n, k in enumerate(sorted(kept)[:3])}
    got = {(r.oks_id, r.place, r.line_id, r.at_m) for r in geometry.free_points(spark, sf_dir).collect()}
    assert len(got) == len(want) and {(a, b, c, round(d, 2)) for a, b, c, d in got} == {(a, b, c, round(d, 2)) for a, b, c, d in want}


def test_clusters(spark):
    """Cells whose nearest points lie apart from their centres' side are compared point by point."""
    import random

    from pipeloom.operators.spatial import clusters

    r = random.Random(4)
    pts = [(i, r.uniform(0, 60), r.uniform(0, 60)) for i in range(120)] + [(200, 500.0, 500.0)]
    root = {i: i for i, *_ in pts}
    for _ in range(12):
        for i, x, y in pts:
            for j, u, v in pts:
                if math.dist((x, y), (u, v)) <= 5.0:
                    root[i] = root[j] = min(root[i], root[j])
    got = {q.i: q.group_id for q in clusters(spark.createDataFrame(pts, "i long, x double, y double"), 5.0, "i").collect()}
    assert got == root
