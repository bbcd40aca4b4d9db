"""Reference tables of the domain and expressions over them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dn, capacity t/h, longest run m, new pipe per m, reconstruction per m.
DIAMETERS = [
    (50, "3.5", 181, 74023, 96180),
    (65, "8.3", 245, 78631, 109989),
    (80, "13.2", 327, 83530, 117582),
    (100, "22.3", 419, 89748, 133694),
    (125, "40.2", 554, 97275, 148030),
    (150, "65.1", 696, 105507, 152295),
    (200, "152.3", 1042, 120275, 181766),
    (250, "274.9", 1379, 135323, 202030),
    (300, "437.4", 1718, 150022, 228707),
    (400, "943.1", 2477, 190299, 271317),
    (500, "1663.4", 3245, 224137, 333884),
    (600, "2627.7", 4037, 264790, 372703),
    (700, "3735.1", 4775, 324298, 439571),
    (800, "5296.8", 5644, 325996, 489918),
    (900, "7165.0", 6518, 327693, 553607),
    (1000, "9391.8", 7419, 418777, 606679),
    (1200, "15012.8", 9288, 428074, 825692),
    (1400, "22501.9", 11276, 683417, 978584),
]
# Outer diameter m, width m, height m of a laid pair, by dn.
GABARITS = {
    50: (0.125, 0.4), 65: (0.14, 0.43), 80: (0.16, 0.47), 100: (0.18, 0.51), 125: (0.225, 0.6), 150: (0.25, 0.65), 200: (0.315, 0.88), 250: (0.4, 1.05), 300: (0.45, 1.15),
    400: (0.56, 1.37), 500: (0.71, 1.67), 600: (0.8, 1.85), 700: (0.9, 2.05), 800: (1.0, 2.25), 900: (1.1, 2.45), 1000: (1.2, 2.65), 1200: (1.425, 3.1), 1400: (1.6, 3.45),
}
# Restriction rules: prohibited or special, offset m (by dn where None), special coefficient.
RULES = {
    "oks_existing": ("prohibited", None, None), "park": ("prohibited", 1.0, None), "social_area": ("prohibited", 1.0, None), "prohibited_site": ("prohibited", 1.0, None),
    "water": ("prohibited", 1.0, None), "railway": ("prohibited", 1.0, None), "road": ("special", 1.5, "1.60"), "tram_tracks": ("special", 1.5, "1.75"),
    "gas_pipeline": ("special", 2.0, "1.25"), "power_cable": ("special", 2.0, "1.15"), "heat_network": ("special", 1.0, "1.05"),
}
# Fixed values: (largest dn of the band, cost of a new chamber), (largest dn of the band, offset from buildings m).
CHAMBER_BANDS = [(200, 3_000_000), (500, 5_000_000), (1000, 8_000_000), (1400, 12_000_000)]
BUILDING_OFFSETS = [(400, 5.0), (800, 7.0), (1400, 9.0)]
TIE_IN_COST, PENALTY, PENALTY_PER_TPH = 5_000_000, 100_000_000, 500_000
UTILITIES = {"gas_pipeline": (2.8, 0.4, 0.2), "power_cable": (2.7, 0.2, 0.5), "heat_network": (3.0, None, 0.5)}


def _check() -> None:
    for a, b in zip(DIAMETERS, DIAMETERS[1:]):
        if a[0] >= b[0] or Decimal(a[1]) >= Decimal(b[1]) or a[2] >= b[2]:
            raise ValueError(f"diameters must ascend: {a} {b}")
    if set(GABARITS) != {d[0] for d in DIAMETERS} or CHAMBER_BANDS[-1][0] < DIAMETERS[-1][0] or BUILDING_OFFSETS[-1][0] < DIAMETERS[-1][0]:
        raise ValueError("every dn needs a size, a chamber band and an offset")


_check()


def min_dn(flow: Column) -> Column:
    """The smallest dn whose capacity covers the flow; the largest dn above all; null for null."""
    out = F.when(flow.isNull(), F.lit(None).cast("int"))
    for dn, capacity, *_ in DIAMETERS[:-1]:
        out = out.when(flow <= F.lit(Decimal(capacity)), F.lit(dn))
    return out.otherwise(F.lit(DIAMETERS[-1][0]))


def by_dn(dn: Column, at: int) -> Column:
    """A column of the diameter table: 1 capacity, 2 longest run, 3 new price, 4 reconstruction price. An unknown dn is an error."""
    out = F.when(dn.isNull(), None)
    for row in DIAMETERS:
        out = out.when(dn == row[0], F.lit(Decimal(row[1]) if at == 1 else row[at]))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown dn "), dn.cast("string"))))


def band(dn: Column, bands: list) -> Column:
    out = F.when(dn.isNull(), None)
    for last, value in bands:
        out = out.when(dn <= last, F.lit(value))
    return out


def roubles(amount: Column) -> Column:
    """Whole roubles, half up."""
    return F.round(amount, 0).cast("bigint")


def segment_cost(length: Column, dn: Column, k_spec: Column, k_depth: Column | None = None) -> Column:
    price = by_dn(dn, 3).cast("decimal(10,0)")
    product = length.cast("decimal(12,3)") * price * k_spec.cast("decimal(4,2)")
    return roubles(product if k_depth is None else product * k_depth.cast("decimal(6,4)"))


def penalty(flow: Column) -> Column:
    return roubles(F.lit(PENALTY).cast("decimal(12,0)") + F.lit(PENALTY_PER_TPH).cast("decimal(8,0)") * flow.cast("decimal(18,2)"))


def raw_score(cost: Column, length: Column) -> Column:
    """For ordering; rounded only for output."""
    return F.lit(0.7) * cost.cast("double") / F.lit(25e6) + F.lit(0.3) * length.cast("double") / F.lit(100.0)


# The same tables for oracle texts.
def sql_case(column: str, at: int) -> str:
    return "case " + " ".join(f"when {column} = {r[0]} then {r[at]}" for r in DIAMETERS) + " end"


def sql_min_dn(flow: str) -> str:
    return f"coalesce((select min(dn) from (values {', '.join(f'({r[0]}, {r[1]}::decimal(12,2))' for r in DIAMETERS)}) t(dn, cap) where cap >= {flow}), 1400)"


def sql_band(column: str, bands: list) -> str:
    return "case " + " ".join(f"when {column} <= {last} then {value}" for last, value in bands) + " end"
