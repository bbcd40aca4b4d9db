import heapq
import itertools
import math
import random

import pytest

from pipeloom.functions.reference import CHAMBER_BANDS, DIAMETERS
from pipeloom.operators.diameters import cheapest_diameters
from pipeloom.operators.limits import raise_for_length
from pipeloom.operators.optimise import greedy_tree
from pipeloom.operators.route_trees import merged_routes
from pipeloom.operators.search import cheapest, cheapest_states, traced
from pipeloom.operators.untangle import untangled
from pipeloom.sources.geojson import parse_features


DN, CAPACITY, LONGEST, PRICE = [d[0] for d in DIAMETERS], [float(d[1]) for d in DIAMETERS], [d[2] for d in DIAMETERS], [d[3] for d in DIAMETERS]


def price(nodes, children, length, dn):
    return sum(round(length[n] * PRICE[dn[n]]) + (next(c for last, c in CHAMBER_BANDS if DN[dn[n]] <= last) if len(children[n]) > 1 else 0) for n in nodes)


def brute(nodes, children, parent, length, flow, dns):
    best = None
    for pick in itertools.product(range(dns), repeat=len(nodes)):
        dn = dict(zip(nodes, pick))
        if any(flow[n] > CAPACITY[dn[n]] or (parent[n] is not None and dn[n] > dn[parent[n]]) for n in nodes):
            continue
        run, ok = {}, True
        for n in sorted(nodes, reverse=True):
            run[n] = length[n] + max([run[c] for c in children[n] if dn[c] == dn[n]], default=0)
            ok &= run[n] <= LONGEST[dn[n]] + 0.01
        if ok:
            cost = price(nodes, children, length, dn)
            best = cost if best is None else min(best, cost)
    return best


def test_cheapest_diameters_equal_brute_force(spark):
    """All trees in one forest: 24 random ones, one whose run limit raises the dn, one that just keeps it, one without a choice."""
    r = random.Random(3)
    forest, trees = [], []
    for t in range(27):
        n = r.randrange(1, 7) if t < 24 else 2 if t < 26 else 1
        nodes = [10 * t + i for i in range(n)]
        parent = {i: None if i == nodes[0] else r.choice([j for j in nodes if j < i]) for i in nodes}
        length = {i: r.choice([20.0, 90.0, 150.0, 200.0]) for i in nodes}
        flow = {i: r.choice([1.0, 3.0, 6.0]) for i in nodes}
        for i in reversed(nodes[1:]):
            flow[parent[i]] += flow[i]
        if t in (24, 25):
            length, flow = {nodes[0]: 100.0, nodes[1]: 100.0 if t == 24 else 81.005}, dict.fromkeys(nodes, 3.0)
        if t == 26:
            length = {nodes[0]: 20000.0}
        trees.append((nodes, parent, length, flow))
        forest += [(i, parent[i], length[i], flow[i]) for i in nodes]
    got = {x.node_id: x.dn for x in cheapest_diameters(spark.createDataFrame(forest, "node_id long, parent_id long, length_m double, flow double")).collect()}
    assert len(got) == len(forest)
    for nodes, parent, length, flow in trees[:26]:
        children = {i: [c for c in nodes if parent[c] == i] for i in nodes}
        want = brute(nodes, children, parent, length, flow, 6)
        cost = price(nodes, children, length, {i: DN.index(got[i]) for i in nodes})
        assert want is None or cost <= want
        assert brute(nodes, children, parent, length, flow, 1 + max(DN.index(got[i]) for i in nodes)) == cost or want is None
    assert got[240] == 65 and {got[250], got[251]} == {50} and got[260] is None


def turn(a, b, c):
    x = math.atan2(b[1] - a[1], b[0] - a[0]) - math.atan2(c[1] - b[1], c[0] - b[0])
    return abs(math.degrees(math.atan2(math.sin(x), math.cos(x))))


def brute_ways(points, edges, starts, most=90.0, free=5.0, turn_cost=10.0):
    """Least cost of each node, by a queue over (node before, node)."""
    queue, done, best = [(c, -1, n) for n, c in starts.items()], set(), {}
    heapq.heapify(queue)
    while queue:
        cost, before, at = heapq.heappop(queue)
        if (before, at) in done:
            continue
        done.add((before, at))
        best.setdefault(at, cost)
        for to, d in edges.get(at, {}).items():
            bend = 0.0 if before < 0 else turn(points[before], points[at], points[to])
            if bend <= most + 1e-6:
                heapq.heappush(queue, (cost + d + (turn_cost if bend > free else 0.0), at, to))
    return best


@pytest.mark.parametrize("seed,bucket", [(1, 20.0), (2, 1e9), (3, 60.0)])
def test_cheapest_ways_equal_a_queue(spark, seed, bucket):
    draw = random.Random(seed)
    points = {i: (draw.uniform(0, 300), draw.uniform(0, 300)) for i in range(90)} | {200: (900.0, 900.0), 201: (905.0, 900.0)}
    pairs = [(a, b) for a in range(90) for b in range(a) if math.dist(points[a], points[b]) < 60 and draw.random() < 0.8] + [(200, 201)]
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, {})[b] = edges.setdefault(b, {})[a] = math.dist(points[a], points[b])
    rows = [(a, b, *points[a], *points[b], math.dist(points[a], points[b])) for a, b in pairs] + [(3, 3, 0.0, 0.0, 0.0, 0.0, 0.0)] + [(pairs[0][1], pairs[0][0], *points[pairs[0][1]], *points[pairs[0][0]], 1e3)]
    table = spark.createDataFrame(rows, "a long, b long, ax double, ay double, bx double, by double, d double")
    starts = {0: 0.0, 1: 25.0}
    begun = spark.createDataFrame([*starts.items(), (0, 9.0)], "node long, cost double").groupBy("node").min("cost").withColumnRenamed("min(cost)", "cost")
    states = cheapest_states(table, begun, bucket=bucket)
    found = cheapest(states, begun)
    want = brute_ways(points, edges, starts)
    got = {r.node: r for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[n].cost - want[n]) < 1e-9 for n in want) and 200 not in got
    ways = {}
    for r in traced(states, found).collect():
        ways.setdefault(r.goal, []).append((r.place, r.node))
    for goal, way in ways.items():
        way = [n for _, n in sorted(way)]
        assert way[-1] == goal and way[0] == got[goal].source and len(way) == got[goal].hops + 1
        bends = [turn(points[a], points[b], points[c]) for a, b, c in zip(way, way[1:], way[2:])]
        assert max(bends, default=0) <= 90.0001 and abs(starts[way[0]] + sum(edges[a][b] for a, b in zip(way, way[1:])) + 10 * sum(x > 5 for x in bends) - got[goal].cost) < 1e-9
    near = sorted(want, key=want.get)[:20]
    early = cheapest(cheapest_states(table, begun, spark.createDataFrame([(n,) for n in near], "node long"), bucket=bucket), begun)
    assert all(abs(r.cost - want[r.node]) < 1e-9 for r in early.collect() if r.node in near)
    assert cheapest_states(table, begun.limit(0)).count() == 0


def test_sharp_turns_are_no_way(spark):
    points = {0: (0.0, 0.0), 1: (10.0, 0.0), 2: (9.0, 1.0), 3: (10.0, 20.0)}
    rows = [(a, b, *points[a], *points[b], math.dist(points[a], points[b])) for a, b in ((0, 1), (1, 2), (2, 3))]
    table, begun = spark.createDataFrame(rows, "a long, b long, ax double, ay double, bx double, by double, d double"), spark.createDataFrame([(0, 0.0)], "node long, cost double")
    assert {r.node for r in cheapest(cheapest_states(table, begun), begun).collect()} == {0, 1}
    assert {r.node for r in cheapest(cheapest_states(table, begun, most=180.0), begun).collect()} == {0, 1, 2, 3}


def test_greedy_tree_joins_all():
    got = greedy_tree([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 400.0, 0.0)], [(9, 0.0, 3.0)], 89748.0)
    assert [g[:3] for g in got] == [(1, "chamber", 9), (2, "demand", 1), (3, "chamber", 9)] or got[0][:3] == (1, "chamber", 9)
    assert {g[0] for g in got} == {1, 2, 3} and greedy_tree([(1, 0.0, 0.0)], [], 1.0) == []


def test_geojson_problems(spark):
    rows = [
        '{"type":"Feature","geometry":{"coordinates":[37.5,55.7],"type":"Point"},"properties":{"id":7,"object_type":"Heat-Chamber "}}',
        '{"type":"Feature","properties":{"object_type":"source"},"geometry":{"type":"Point","coordinates":[1,2]},"id":"s-1"}',
        '{"type":"Feature","properties":{"id":1},"geometry":null}', "not json", '{"properties":{"id":3,"object_type":"source"},"geometry":null}',
    ]
    got = parse_features(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r.id, r.kind, r.problem) for r in got] == [("7", "chamber", None), ("s-1", "source", None), ("1", None, "MISSING_OBJECT_TYPE"), (None, None, "FEATURE_PARSE"), ("3", "source", "MISSING_GEOMETRY")]
    assert [r.id_is_number for r in got[:2]] == [True, False]


def brute_limits(parent, length, dn):
    dn = dict(dn)
    depth = {n: 0 for n in parent}
    for n in parent:
        p = parent[n]
        while p is not None:
            depth[n], p = depth[n] + 1, parent[p]
    leaves = set(parent) - set(parent.values())
    while True:
        for n in sorted(parent, key=depth.get, reverse=True):
            if parent[n] is not None:
                dn[parent[n]] = max(dn[parent[n]], dn[n])
        over = set()
        for leaf in leaves:
            way, n = [], leaf
            while n is not None:
                way.append(n)
                n = parent[n]
            for _, run in itertools.groupby(way, key=dn.get):
                run = list(run)
                if sum(length[n] for n in run) > LONGEST[DN.index(dn[run[0]])] + 0.01:
                    over |= set(run)
        raised = {n for n in over if dn[n] < DN[-1]}
        if not raised:
            return {n: (dn[n], n in over) for n in parent}
        for n in raised:
            dn[n] = DN[DN.index(dn[n]) + 1]


def test_length_limits(spark):
    """Fixed answers for one chain or fork each, and brute force on random trees."""
    cases = [([None, 1], [100, 100], [50, 50], [65, 65]), ([None, 1], [150, 150], [50, 50], [80, 80]), ([None, 1], [100, "81.005"], [50, 50], [50, 50]), ([None, 1, 1], [150, 150, 200], [100, 50, 100], [100, 50, 100]), ([None], [99999], [50], [1400])]
    parent, length, dn, want = {}, {}, {}, {}
    for k, (ups, metres, sizes, out) in enumerate(cases):
        for i, (u, m, s, o) in enumerate(zip(ups, metres, sizes, out)):
            n = 100 * k + i + 1
            parent[n], length[n], dn[n], want[n] = None if u is None else 100 * k + u, float(m), s, o
    draw = random.Random(8)
    for tree in range(40):
        for i in range(draw.randint(1, 25)):
            n = 10_000 + 100 * tree + i
            parent[n], length[n], dn[n] = None if i == 0 else draw.choice([n - 1, 10_000 + 100 * tree + draw.randrange(i)]), draw.randint(1, 40000) / 100, draw.choice(DN[:5])
    rows = [(n, parent[n], str(length[n]), dn[n]) for n in parent]
    table = spark.createDataFrame(rows, "node_id long, parent_id long, length string, dn int").selectExpr("node_id", "parent_id", "cast(length as decimal(18,3)) as length_m", "dn")
    got = {r.node_id: (r.dn, r.too_long) for r in raise_for_length(table).collect()}
    assert got == brute_limits(parent, length, dn)
    assert {n: got[n][0] for n in want} == want and got[401] == (1400, True) and raise_for_length(table.limit(0)).count() == 0


def test_untangled_forests(spark):
    draw = random.Random(6)
    nodes = [(0, None, 0.0, 0.0), (1, None, 200.0, 200.0)] + [(i, draw.choice([i - 1 if i > 2 else 0, draw.randrange(2), draw.randrange(i)]), draw.uniform(0, 200), draw.uniform(0, 200)) for i in range(2, 70)]
    nodes += [(500, None, 1000.0, 1000.0), (501, 500, 1100.0, 1000.0), (502, 501, 1100.0, 1100.0), (503, 502, 1050.0, 900.0), (600, None, 5000.0, 5000.0)]
    schema = "node_id long, parent_id long, x double, y double"
    out = {r.node_id: r for r in untangled(spark.createDataFrame(nodes, schema)).collect()}
    assert {n[0] for n in nodes} == {i for i, r in out.items() if not r.chamber} and all(i < 0 for i, r in out.items() if r.chamber)
    root = {n[0]: n[0] for n in nodes if n[1] is None}
    for i, r in out.items():
        way, at = [], i
        while out[at].parent_id is not None:
            way.append(at)
            at = out[at].parent_id
            assert len(way) <= len(out)
        assert at in root
    segments = [(i, (out[r.parent_id].x, out[r.parent_id].y), (r.x, r.y)) for i, r in out.items() if r.parent_id is not None]
    side = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    apart = lambda p, a, b: abs(side(p, a, b)) > 0.05 * math.dist(a, b)  # noqa: E731  not at a place where the tolerance lets ends touch
    for k, (_, a, b) in enumerate(segments):
        for _, c, d in segments[:k]:
            cross = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
            assert not (cross and all(apart(*q) for q in ((a, c, d), (b, c, d), (c, a, b), (d, a, b))))
    length = lambda rows: sum(math.dist(rows[r[0]][2:4], rows[r[1]][2:4]) for r in rows.values() if r[1] is not None)
    assert length({i: (i, r.parent_id, r.x, r.y) for i, r in out.items()}) <= length({n[0]: n for n in nodes}) + 1e-6
    assert all(out[i].parent_id is None for i in root)
    [chamber] = [r for r in out.values() if r.chamber and r.x > 900]  # 503's pipe is cut where it crosses 501's, and hangs from there
    assert (round(chamber.x, 6), round(chamber.y, 6), chamber.parent_id) == (1075.0, 1000.0, 500) and out[501].parent_id == out[503].parent_id == chamber.node_id and out[502].parent_id == 501
    assert untangled(spark.createDataFrame([], schema)).count() == 0


def test_merged_routes(spark):
    draw = random.Random(1)
    corner = lambda: (draw.randrange(4) * 10.0, draw.randrange(4) * 10.0)
    routes = {i: [(0.0, 0.0), *(corner() for _ in range(draw.randint(1, 4)))] for i in range(60)} | {100: [(500.0, 0.0), (500.001, 0.0), (510.0, 0.0)], 101: [(500.002, 0.0), (510.0, 0.0), (520.0, 0.0)], 102: [(900.0, 900.0)], 103: []}
    table = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in routes.items()], "route_id long, points array<struct<x:double,y:double>>")
    tree = merged_routes(table)
    nodes = {r.node_id: r for r in tree.nodes.collect()}
    ends = {r.route_id: r.node_id for r in tree.ends.collect()}
    assert set(ends) == set(routes) - {103}
    want = set()
    for i, at in ends.items():
        way = []
        while at is not None:
            if nodes[at].kind != "cascade":
                way.append((round(nodes[at].x, 2), round(nodes[at].y, 2)))
            at = nodes[at].parent_id
        snapped = [(round(x, 2), round(y, 2)) for x, y in routes[i]]
        snapped = [p for p, q in zip(snapped, [None, *snapped]) if p != q]
        assert way[::-1] == snapped
        want |= {tuple(snapped[: k + 1]) for k in range(len(snapped))}
    assert sum(r.kind != "cascade" for r in nodes.values()) == len(want)
    ways = {}
    for r in nodes.values():
        ways.setdefault(r.parent_id, []).append(r)
    assert all(len(v) <= 3 for p, v in ways.items() if p is not None) and any(r.kind == "cascade" for r in nodes.values())
    assert sum(r.n_routes for r in ways[None]) == len(ends)
    for p, v in ways.items():
        if p is not None:
            inside = sum(1 for i in ends.values() if i == p)
            assert nodes[p].n_routes == sum(r.n_routes for r in v) + inside or any(r.kind == "cascade" for r in v)
    assert nodes[ends[101]].depth == 2 and nodes[nodes[ends[101]].parent_id].kind == "point" and merged_routes(table.limit(0)).nodes.count() == 0
