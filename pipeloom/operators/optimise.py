"""Search operators over small groups: the kernels run in grouped tasks, Spark deals the groups."""

from __future__ import annotations

import math

import pandas as pd

from pipeloom.functions.reference import DIAMETERS, TIE_IN_COST

PRICE = [float(d[3]) for d in DIAMETERS]


def greedy_tree(demands: list[tuple[int, float, float]], chambers: list[tuple[int, float, float]], price: float) -> list[tuple[int, str, int, float]]:
    """(demand, kind, target, metres) in the order of commitment: each round joins the waiting demand that is cheapest to
    join, to a chamber (at the cost of a tie-in, in metres of pipe) or to a demand that has been joined."""
    waiting, joined, out = {d[0]: d for d in demands}, [], []
    anchors = [("chamber", c, x, y, TIE_IN_COST / price) for c, x, y in chambers]
    while waiting and (anchors or joined):
        tries = []
        for i, x, y in waiting.values():
            for kind, target, ax, ay, extra in anchors + joined:
                m = math.hypot(x - ax, y - ay)
                tries.append((round(m + extra, 6), i, kind, target, m))
        _, i, kind, target, m = min(tries)
        out.append((i, kind, target, round(m, 6)))
        joined.append(("demand", i, waiting[i][1], waiting[i][2], 0.0))
        del waiting[i]
    return out


def greedy_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas kernel over (group_id, oks_id, x, y, chamber_id, bx, by) of one group of demands with chambers in reach."""
    demands = sorted({(int(r.oks_id), r.x, r.y) for r in pdf.itertuples()})
    chambers = sorted({(int(r.chamber_id), r.bx, r.by) for r in pdf.itertuples() if not pd.isna(r.chamber_id)})
    got = greedy_tree(demands, chambers, PRICE[3])
    lost = sorted({d[0] for d in demands} - {g[0] for g in got})
    rows = [(int(pdf.group_id.iloc[0]), k, *g) for k, g in enumerate(got)] + [(int(pdf.group_id.iloc[0]), -1, i, "unconnected", None, None) for i in lost]
    return pd.DataFrame(rows, columns=["group_id", "round", "oks_id", "kind", "target_id", "length_m"]).astype({"target_id": "Int64"})
